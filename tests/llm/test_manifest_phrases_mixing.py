"""The Merkle manifest, phrase collocations and source mixing against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import brute
import pytest
from test_corpus_operators import ODD, frame

KIND = "doc_id long, text string, lang string, source string, n_chars long"
DIR = "/root/testdata/sf0.001"


# --- manifest ---------------------------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, cut=False):
    doc_id, text, lang, source, n_chars = row
    text = text.replace("\n", "") if cut and text is not None else text
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(nodes, folded):
    """(root, per node the siblings to the root, per node its folded value at the root)."""
    at, paths = {i: i for i in range(len(nodes))}, defaultdict(list)
    now = list(nodes)
    while len(now) > 1:
        for i in at:
            run, place = at[i] // 3 * 3, at[i] % 3
            kids = now[run : run + 3]
            paths[i] += kids[:place] + kids[place + 1 :]
            folded[i] = digest(*kids[:place], folded[i], *kids[place + 1 :])
            at[i] //= 3
        now = [digest(*now[i : i + 3]) for i in range(0, len(now), 3)]
    return now[0], paths, folded


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    low, subroots = {}, []
    for s in sources:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        claimed = [leaf(r, r[0] is not None and brute.remainder(r[0], 2) == 0) for r in own]
        root, paths, folded = tree([leaf(r) for r in own], dict(enumerate(claimed)))
        subroots.append(root)
        low[s] = (own, paths, folded)
    top, above, _ = tree(subroots, dict(enumerate(subroots)))
    out = []
    for k, s in enumerate(sources):
        own, paths, folded = low[s]
        for i, r in enumerate(own):
            end = tree(subroots, {j: folded[i] if j == k else subroots[j] for j in range(len(subroots))})[2][k]
            out.append((r[0], leaf(r), subroots[k], top, digest(*paths[i], *above[k]), end, end == top))
    return sorted(out, key=repr)


def proved(spark, rows, **more):
    from parallaxis.llm.merkle import prove, without_newlines

    docs = spark.createDataFrame(rows, KIND).selectExpr("*", *[f"{v} as {k}" for k, v in more.items()])
    return sorted((tuple(r) for r in prove(docs, without_newlines()).collect()), key=repr)


def test_manifest(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert proved(spark, rows) == plain_manifest(rows)


def test_manifest_odd_rows(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*ODD, "a\nb", "a\nb\n", "\n", "x\r\ny"])]
    rows += [(None, "null id\n", None, "s", None), (None, None, None, None, None), (3, "twice\n", "en", "s", 1), (3, "twice\n", "en", "s", 1), (3, "other", "en", "s", 1)]
    rows += [(100 + i, f"t{i}\n", "en", x, 2) for i, x in enumerate(["", "é", "Z", "a", "ab", "\u4e00", "\U0001f600", "\uffff"])]
    assert proved(spark, rows, leaf="1", root="2", subroot="3", chunk="4", idx="5") == plain_manifest(rows)
    assert proved(spark, rows[:1]) == plain_manifest(rows[:1]) and proved(spark, rows[:1])[0][4] == digest()
    assert proved(spark, []) == []
    spark.conf.set("spark.sql.cteRecursionRowLimit", "123")
    proved(spark, rows[:2])
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "123"
    spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("merkle")]


def test_manifest_over_many_chunks(spark):
    """Sources around the size of a chunk and its multiples, one of them with most rows."""
    from parallaxis.llm.merkle import CHUNK

    rows, i = [], 0
    for s, n in (("a", CHUNK - 1), ("b", CHUNK), ("c", CHUNK + 1), ("hot", 3 * CHUNK + 5), ("one", 1)):
        for _ in range(n):
            rows.append((i, f"t {i % 7}\n" * (i % 3), "en", s, i))
            i += 1
    random.Random(1).shuffle(rows)
    assert proved(spark, rows) == plain_manifest(rows)


# --- collocations -----------------------------------------------------------------------------------------------------


def plain_collocations(rows, least=30, longest=4, top=2000):
    """rows: (text, lang)."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, own in counts.items():
        own = {g: f for g, f in own.items() if f >= least}
        inside = Counter()
        for g, f in own.items():
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    inside[g[i : i + n]] = max(inside[g[i : i + n]], f)
        found = []
        for g, a in own.items():
            if len(g) > 1 and 100 * inside[g] < 80 * a:
                score, k = min((2_000_000 * a // (own[g[:k]] + own[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def found(spark, rows, **options):
    from parallaxis.llm.phrases import collocations

    docs = spark.createDataFrame([(i, t, g, None, None) for i, (t, g) in enumerate(rows)], KIND).selectExpr("*", "1 as phrase", "2 as f", "3 as n")
    return sorted(tuple(r) for r in collocations(docs, **options).collect())


def test_collocations_of_documents(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    for least in (30, 3):
        got = found(spark, rows, least=least)
        assert got == plain_collocations(rows, least) and len(got) > 5
    assert found(spark, rows, least=2, top=7) == plain_collocations(rows, 2, top=7)


def test_collocations_of_odd_texts(spark):
    r = random.Random(4)
    words = ["a", "A", "b", "ÿ", "\u4e00", "\x01", "a\x01", "b\x0e", "-", "é", "'", "\U0001f600"]
    gaps = [" ", "  ", "\t", ", ", ".", "\n", "\r", "\x0b", " ; ", "?!", ":", " "]
    rows = [(None, "en"), ("", "en"), (" \t\n", None), ("a b c d", None)]
    rows += [("".join(r.choice(words) + r.choice(gaps) for _ in range(r.randint(0, 60))), r.choice(["en", "", "und", None, "x y"])) for _ in range(120)]
    rows += [("of the same words " * 40, "en")] * 3
    for least in (2, 5, 40):
        assert found(spark, rows, least=least) == plain_collocations(rows, least)
    assert found(spark, rows, least=10**6) == [] and found(spark, []) == []


def test_collocations_of_long_texts_and_small_tasks(spark, monkeypatch):
    """Texts and words beyond the windows in which they are hashed; tasks that hold few phrases."""
    from parallaxis.llm import phrases

    long = "x" * 1_100_000
    rows = [(f"one two three, {long} four. " * 3, "en"), ("w1 w2 w3 w4 w5 " * 120_000, "en"), ("w1 w2 w3 " * 50, "de")]
    assert found(spark, rows, least=3) == plain_collocations(rows, 3)
    monkeypatch.setattr(phrases, "HELD", 4)
    rows = [(f"a b c d {i % 5} a b" * 5, "en") for i in range(50)]
    assert found(spark, rows) == plain_collocations(rows)


def test_rare_phrases_of_frequent_words_never_become_rows(spark, monkeypatch):
    """150000 words, each of 300 some 500 times, and hardly a pair twice: what tasks hand on stays far below a row a pair."""
    r = random.Random(7)
    rows = [(" ".join(f"w{r.randrange(300)}" for _ in range(1500)) + " . same old end" * (i < 40), "en") for i in range(100)]
    frame_type = type(spark.range(1))
    sent, plain = spark.sparkContext.accumulator(0), frame_type.mapInArrow

    def counted(self, func, schema, *more):
        def run(batches):
            for batch in func(batches):
                sent.add(batch.num_rows)
                yield batch

        return plain(self, run, schema, *more)

    monkeypatch.setattr(frame_type, "mapInArrow", counted)
    got = found(spark, rows)
    assert got == plain_collocations(rows) and [x[2] for x in got] == ["same old end"]
    assert 0 < sent.value < 20_000


# --- mixing -----------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3), epochs=3):
    """{source: target}: exact shares, clamped source by source until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, free, target = sum(sizes.values()), set(order), {}
    while True:
        left, w = total - sum(target.values()), sum(weight[s] for s in free)
        above = [s for s in free if Fraction(left * weight[s], w) > epochs * sizes[s]] if w else []
        if not above:
            return target | {s: Fraction(left * weight[s], w) for s in free}
        for s in above:
            target[s] = Fraction(epochs * sizes[s])
            free.discard(s)


def mixed(spark, rows, **options):
    from parallaxis.llm.mixing import mix

    docs = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], KIND).selectExpr("*", "1 as size", "2 as target", "3 as weight", "4 as taken")
    return mix(docs, **options).collect()


def held_to(rows, got, **options):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.WORD.findall(t or ""))
    want = plain_targets(sizes, **options)
    assert sorted((r.doc_id, r.source or "", r.size) for r in got) == sorted((i, s or "", len(brute.WORD.findall(t or ""))) for i, t, s in rows)
    taken, by = Counter(), defaultdict(list)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        assert r.taken == r.repeats * r.size and r.taken <= options.get("epochs", 3) * r.size
        taken[r.source] += r.taken
        by[r.source].append(r)
    assert sum(want.values()) == sum(sizes.values())
    for s, own in by.items():
        whole = math.floor(want[s] / sizes[s]) if sizes[s] else 0
        assert {r.repeats for r in own if r.size} <= {whole, whole + 1}
        # no document that is left could be added
        short = float(want[s]) - taken[s]
        assert -1e-6 <= short <= max([r.size for r in own if r.repeats == whole], default=0) + 1e-6


def test_mixing(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    got = mixed(spark, rows)
    held_to(rows, got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixed(spark, rows)))
    other = mixed(spark, rows, seed=18)
    held_to(rows, other)
    assert sorted(map(tuple, got)) != sorted(map(tuple, other))


def test_mixing_with_a_hot_source_and_odd_rows(spark):
    r = random.Random(5)
    sizes = {"hot": 300, "small": 3, "tiny": 1, None: 20, "": 15, "é": 30, "Z": 9}
    rows = [("w " * r.randint(0, 40), s) for s, n in sizes.items() for _ in range(n)]
    rows += [(None, "nothing"), ("", "nothing"), (None, None), *[(t, "odd") for t in ODD], ("w " * 3_000, "one"), ("x" * 1_200_000, "one"), ("w " * 700_000, "Z")]
    rows = [(i, t, s) for i, (t, s) in enumerate(rows)]
    held_to(rows, mixed(spark, rows))
    held_to(rows, mixed(spark, rows, weights=(5, 1), epochs=2), weights=(5, 1), epochs=2)
    # several rounds of clamping
    rows = [(i, "w " * 4**k, f"s{k}") for i, k in enumerate(range(9))]
    held_to(rows, mixed(spark, rows))
    assert mixed(spark, []) == [] and [x.taken for x in mixed(spark, [(1, None, "a"), (2, "", None)])] == [0, 0]
    twice = mixed(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (None, "c", "s")])
    assert sorted((x.doc_id or 0, x.taken) for x in twice) == [(0, 1), (0, 1), (1, 2), (1, 2)]


def test_mixing_is_native(spark):
    import inspect

    from parallaxis.llm import mixing

    assert not re.search(r"pandas|arrow|udf|rdd", inspect.getsource(mixing), re.I)
