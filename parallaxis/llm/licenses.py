"""License scans by patience alignment.

A template's words are aligned with a text's: words that stand once in both are anchors, the longest increasing
subsequence of anchors is kept, and each gap between kept anchors is aligned in the same way, where words may be unique
again; equal words next to a kept place or a gap's border are taken along. Coverage is the share of the template's words
that are aligned. Nothing is compared for texts whose words can't reach the least coverage in any order (an exact bound).
The whole text is tried, and the windows of some lengths from each of the template's words on that pass the same bound.

Notices are short templates, made of PHRASES and NAMES: a sentence that names a license isn't its text. They are aligned
like others, in windows of their own length, and count when all their words are. Of several matches the one with the most
aligned words is the license of the text (a template within another's words is covered as well as that, but is shorter),
and one whose span lies within that of a longer one of another name is marked as contained.

Of equally long chains of anchors, that is kept whose places in the template are least, read from the last one.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.

Results for odd input: null and empty texts match nothing; texts of any length are used whole; repeated templates of one
name count once, by most words aligned; ties go to the better coverage, then the lesser name; equal rows get equal results; an empty table gives
no rows; without templates nothing matches; templates without words or with a null count for nothing; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

COVERAGE = 0.8
REACH = (1.0, 1.5, 2.0)  # lengths of windows, in those of the template
WORDS = 1_000_000  # of all templates, at most: they are known to all tasks

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version. {0} is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should "
    "have received a copy of the GNU {1} along with this program. If not, see <https://www.gnu.org/licenses/>."
)

#: fixed values: public license texts and notices, whole, but for names and years: (name, text)
TEMPLATES = (
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. " + _AS_IS,
    ),
    ("bsd-2-clause", _BSD + _BSD_AS_IS),
    (
        "bsd-3-clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission. " + _BSD_AS_IS,
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law. " + _AS_IS.replace("COPYRIGHT HOLDERS ", "").replace("THE AUTHORS OR BE", "THE AUTHORS BE"),
    ),
    ("gpl-3.0", _GNU.format("This program", "General Public License")),
    ("lgpl-3.0", _GNU.format("This program", "Lesser General Public License")),
    ("agpl-3.0", _GNU.format("This program", "Affero General Public License")),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
)

#: fixed values: names by which licenses are referred to
NAMES = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "mit": ("MIT License",),
    "bsd-3-clause": ("BSD 3-Clause License",),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0"),
    "lgpl-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "agpl-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "mpl-2.0": ("Mozilla Public License, version 2.0", "MPL-2.0"),
    "cc-by-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "cc-by-sa-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "cc-by-nc-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
}
PHRASES = ("licensed under {}", "licensed under the {}", "licensed under a {}", "released under {}", "released under the {}", "distributed under the {}", "under the terms of the {}", "SPDX-License-Identifier: {}")
#: notices: every phrase with every name, a template of its own that must be met whole
NOTICES = tuple((name, phrase.format(title)) for name, titles in NAMES.items() for title in titles for phrase in PHRASES)


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting; of several, that with the least values,
    compared from the last."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[pile], piles[pile] = v, i
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Ascending pairs of places with equal words in a and b."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
        shared = sorted((i, once_b[w]) for w, i in once_a.items() if i is not None and once_b.get(w) is not None)
        if not shared:
            continue
        kept = [shared[i] for i in longest_increasing([j for _, j in shared])]
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False) if r - p > 1 and s - q > 1]
    return sorted(out)


def _once(words: list[int], start: int, stop: int) -> dict[int, int | None]:
    """The place of each word that stands once in a range; None for others."""
    out: dict[int, int | None] = {}
    for i in range(start, stop):
        out[words[i]] = None if words[i] in out else i
    return out


class Match(NamedTuple):
    license: str
    coverage: float
    words: int  # aligned
    start: int
    stop: int  # past the last word aligned
    notice: bool
    contained: bool = False


class Templates:
    def __init__(self, templates, notices=()):
        rows = [(name, T.word_hashes(pa.array([text]), T.ALNUM)[0], i >= len(templates)) for i, (name, text) in enumerate([*templates, *notices])]
        self.rows = [(name, words, notice) for name, words, notice in rows if len(words)]
        every = np.unique(np.concatenate([w for _, w, _ in self.rows])) if self.rows else np.zeros(0, np.uint64)
        self.vocabulary = every
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(every >> np.uint64(48)).astype(np.int64)] = True
        self.coded = [np.searchsorted(every, w) for _, w, _ in self.rows]
        self.counts = np.array([np.bincount(c, minlength=len(every)) for c in self.coded]).reshape(len(self.rows), len(every))
        # counts of each template one after the other, for the bound
        self.of, self.word = np.nonzero(self.counts)
        self.most = self.counts[self.of, self.word]
        self.starts = np.searchsorted(self.of, np.arange(len(self.rows)))

    def scan(self, words: np.ndarray, bounds: np.ndarray, least: float) -> list[list[Match]]:
        """For each text its matches, the longest first: of each name the best one of its texts and of its notices."""
        out: list[list[Match]] = [[] for _ in range(len(bounds) - 1)]
        if not self.rows:
            return out
        at = np.flatnonzero(self.maybe[(words >> np.uint64(48)).astype(np.int64)])
        code = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
        real = self.vocabulary[code] == words[at]
        at, code = at[real], code[real]
        cuts = np.searchsorted(at, bounds)
        sizes = self.counts.sum(1)
        asked = np.where([notice for *_, notice in self.rows], sizes, least * sizes)
        for d in np.flatnonzero(np.diff(cuts)):
            own, where = code[cuts[d] : cuts[d + 1]], at[cuts[d] : cuts[d + 1]] - bounds[d]
            have = np.bincount(own, minlength=len(self.vocabulary))
            bound = np.add.reduceat(np.minimum(self.most, have[self.word]), self.starts)
            found: list[Match] = []
            for t in np.flatnonzero(bound >= asked):
                mine = np.isin(own, self.coded[t])
                a, places = own[mine].tolist(), where[mine]
                name, _, notice = self.rows[t]
                look = self._everywhere if notice else self._densest
                for pairs in look(a, places, self.coded[t], self.counts[t], least):
                    found.append(Match(name, len(pairs) / int(sizes[t]), len(pairs), int(places[pairs[0][0]]), int(places[pairs[-1][0]]) + 1, notice))
            out[d] = self._ranked([m for m in found if m.notice or m.coverage >= least])
        return out

    @staticmethod
    def _ranked(found: list[Match]) -> list[Match]:
        """The best match of each name and kind, the longest first; a free one before a contained one."""
        marked = []
        for m in found:
            inside = any(o.words > m.words and o.license != m.license and o.start <= m.start and m.stop <= o.stop for o in found)
            marked.append(m._replace(contained=inside))
        best: dict[tuple[str, bool], Match] = {}
        for m in sorted(marked, key=lambda m: (m.contained, -m.words, -m.coverage, m.start)):
            best.setdefault((m.license, m.notice), m)
        return sorted(best.values(), key=lambda m: (m.contained, -m.words, -m.coverage, m.license))

    @staticmethod
    def _everywhere(a: list[int], places: np.ndarray, b: np.ndarray, counts: np.ndarray, least: float) -> list[list[tuple[int, int]]]:
        """The alignments of all of b in windows of its own length."""
        bound, stop = _window_bounds(np.array(a), places, counts, len(b))
        tried = ((lo, align(a[lo : stop[lo]], b.tolist())) for lo in np.flatnonzero(bound >= len(b)).tolist())
        return [[(p + lo, q) for p, q in own] for lo, own in tried if len(own) == len(b)]

    @staticmethod
    def _densest(a: list[int], places: np.ndarray, b: np.ndarray, counts: np.ndarray, least: float) -> list[list[tuple[int, int]]]:
        """The best alignment of b with a whole text or with any window of a length in REACH that starts at one of its
        words; windows whose words can't win in any order are passed over."""
        b = b.tolist()
        best = align(a, b)
        tried: list[tuple[int, int, int]] = []
        for reach in REACH:
            bound, stop = _window_bounds(np.array(a), places, counts, int(np.ceil(reach * len(b))))
            able = np.flatnonzero(bound >= max(least * len(b), len(best) + 1))
            tried += zip((-bound[able]).tolist(), able.tolist(), stop[able].tolist(), strict=True)
        for bound, lo, hi in sorted(set(tried)):
            if -bound <= len(best):
                break
            own = align(a[lo:hi], b)
            if len(own) > len(best):
                best = [(p + lo, q) for p, q in own]
        return [best] if best else []


def _window_bounds(own: np.ndarray, places: np.ndarray, counts: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For the window of `reach` places from each word on: how many words a template (counts of its words) shares with it
    in any order, and where it stops. A word counts for the windows that hold fewer of its kind before it than the
    template has."""
    n = len(own)
    order = np.argsort(own, kind="stable")
    many = counts[own[order]]
    ahead = np.arange(n) - many
    same = (ahead >= 0) & (own[order[np.maximum(ahead, 0)]] == own[order])
    first = np.zeros(n, np.int64)
    first[order] = np.where(same, order[np.maximum(ahead, 0)] + 1, 0)
    first = np.maximum(first, np.searchsorted(places, places - reach, "right"))
    change = np.bincount(first, minlength=n + 1) - np.bincount(np.arange(n) + 1, minlength=n + 1)
    return np.cumsum(change)[:n], np.searchsorted(places, places + reach)


MATCHES = "array<struct<license:string,coverage:double,words:int,start:int,stop:int,notice:boolean,contained:boolean>>"


def _listed(templates) -> list[tuple[str, str]]:
    """(name, text) rows of a table of templates or of a list; too many words for all tasks to hold are an error."""
    if isinstance(templates, DataFrame):
        rows = templates.select("name", "text").where("name is not null and text is not null")
        if (rows.select(F.sum(F.octet_length("text"))).first()[0] or 0) > 16 * WORDS:
            raise ValueError(f"templates of more than {16 * WORDS} bytes")
        templates = [(r.name, r.text) for r in rows.collect()]
    return list(templates)


def scan(docs: DataFrame, templates=TEMPLATES, least: float = COVERAGE, notices=NOTICES) -> DataFrame:
    """(doc_id, license, coverage, kind, matches, referred) for each row of docs: the license with the most aligned words,
    or null and 0; whether that is by its text or a notice; all matches; and the names with a notice that isn't contained
    in a longer match of another name.

    templates and notices: tables (name, text) or lists of such rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates(_listed(templates), _listed(notices)))
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("words", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("notice", pa.bool_()), ("contained", pa.bool_())]))

    def run(batches):
        for batch in T.pieces_of(batches):
            words, bounds = T.word_hashes(batch.column("text"), T.ALNUM)
            found = shared.value.scan(words, bounds, least)
            first = [x[0] if x else None for x in found]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([m and m.license for m in first], pa.string()),
                    pa.array([m.coverage if m else 0.0 for m in first], pa.float64()),
                    pa.array([m and ("notice" if m.notice else "text") for m in first], pa.string()),
                    pa.array([[m._asdict() for m in x] for x in found], kind),
                    pa.array([[m.license for m in sorted(x, key=lambda m: m.start) if m.notice and not m.contained] for x in found], pa.list_(pa.string())),
                ],
                ["doc_id", "license", "coverage", "kind", "matches", "referred"],
            )

    return T.bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, license string, coverage double, kind string, matches {MATCHES}, referred array<string>")
