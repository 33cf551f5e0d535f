"""SentencePiece encoding with N-best segmentations, and exact decoding.

The piece lattice of a text has an edge for every piece that matches, and for every byte its byte piece. Pieces only
begin with spaces, so the lattice falls apart at the first space of each run: a text is a row of chunks, and only
distinct chunks are segmented. Forward Viterbi scores are computed for all chunks of a batch at once, a column of the
lattice at a time. With the scores from behind they give, for each chunk, how much its second-best segmentation loses.
Chunks of more than LONG bytes (text without spaces) are searched one by one, in time that grows with their length.

The N best segmentations of a text change only chunks among the N - 1 with the least loss. For these, an A* search runs
backward through the chunk's lattice: the forward Viterbi score of a place is the exact cost of what is left, so paths
come out in order of their scores. The chunks' lists are then merged to the text's.

Piece scores: a unigram model's are log likelihoods and used as they are; those of a merge model are ranks and count as
log(1 / (rank + 1)), normalised (Zipf's law). A byte piece costs 10 more than the rarest piece.

Spaces are replaced by the mark of the model and a text gets one in front, as the model asks for; a mark that stands in
the text itself is encoded by bytes, so decoding gives every text back exactly, whatever it holds.

Results for odd input: a null text has null ids, an empty one no ids, both no alternatives; a text with fewer than N
segmentations has all of them; ties go to the longer last piece, then to the earlier chunk; texts of any length are used
whole; equal rows get equal results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import _text as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N = 3
MARK = "▁"
LONG = 256  # bytes; longer chunks are segmented one by one
LONG_BLOCK = 1 << 16
KNOWN = 1 << 17  # chunks whose segmentations a task keeps
SPACE, PAD = 0xFF, 0xFE  # bytes that UTF-8 never has: the model's mark for a space, and filling
U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)


class Pieces:
    """The pieces of a model, without its library."""

    def __init__(self, pieces: list[tuple[int, bytes, float]], byte_ids: list[int], byte_score: float, size: int):
        self.byte_ids = np.array(byte_ids, np.int32)
        self.byte_score = byte_score
        self.table = {b: (i, s) for i, b, s in pieces}
        self.longest = max(map(len, self.table))
        self.text: list[bytes | None] = [None] * size
        for i, b, _ in pieces:
            self.text[i] = b
        for value, i in enumerate(byte_ids):
            self.text[i] = bytes([value])
        self.plain = pa.array([b and b.replace(bytes([SPACE]), b" ") for b in self.text], pa.large_binary())
        if any(SPACE in b.lstrip(bytes([SPACE])) for b in self.table):
            raise ValueError("a piece has a space behind other characters")
        hashes = np.array([self._hash(b) for b in self.table], np.uint64)
        order = np.argsort(hashes)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        self.hashes = hashes[order]
        self.ids = np.array([i for i, _ in self.table.values()], np.int32)[order]
        self.scores = np.array([s for _, s in self.table.values()])[order]
        self.maybe = np.zeros(1 << 21, bool)
        self.maybe[self.place(self.hashes)] = True

    @staticmethod
    def _hash(b: bytes) -> int:
        h = 0
        for x in b:
            h = (h * int(_P) + x + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def place(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9) >> U64(43)).astype(np.int64)


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain, byte_ids = [], [0] * 256
    for i in range(size):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            plain.append((i, model.id_to_piece(i).encode().replace(MARK.encode(), bytes([SPACE])), model.get_score(i)))
    scores = np.array([s for _, _, s in plain])
    if np.array_equal(scores, np.round(scores)) and scores.min() < -100:  # merge ranks
        scores = -np.log1p(-scores)
        scores -= np.log(np.exp(scores).sum())
    return Pieces([(i, b, float(s)) for (i, b, _), s in zip(plain, scores, strict=True)], byte_ids, float(scores.min()) - 10, size)


# --- one chunk --------------------------------------------------------------------------------------------------------

_current: Pieces | None = None


def _lattice(chunk: bytes, pieces: Pieces) -> tuple[list[int], list[int], list[int], list[float]]:
    """(bounds by end, starts, ids, scores) of the edges of one chunk; those of one end are in the order of their starts.

    Pieces are found for all places at once, by the hash of each size, in blocks of places.
    """
    size = len(chunk)
    if size <= LONG:
        return _short_lattice(chunk, pieces)
    data = np.frombuffer(chunk, np.uint8)
    byte_of = np.zeros(256, np.int64)
    byte_of[: len(pieces.byte_ids)] = pieces.byte_ids
    byte_of[SPACE] = byte_of[0x20]
    at_byte = byte_of[data]
    ends, starts, ids, scores = [np.arange(1, size + 1)], [np.arange(size)], [at_byte], [np.full(size, pieces.byte_score)]
    for low in range(0, size, LONG_BLOCK):  # ends in (low, high]
        base, high = max(0, low - pieces.longest), min(size, low + LONG_BLOCK)
        up, down = T._power_tables(high - base + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data[base:high].astype(np.uint64) + U64(1)) * down[: high - base], dtype=np.uint64)))
        for n in range(min(pieces.longest, high - base), 0, -1):
            end = np.arange(max(low + 1, base + n), high + 1) - base
            h = (total[end] - total[end - n]) * up[end - 1]
            hit = np.flatnonzero(pieces.maybe[pieces.place(h)])
            if len(hit):
                h, end = h[hit], end[hit]
                at = np.minimum(np.searchsorted(pieces.hashes, h), len(pieces.hashes) - 1)
                real = pieces.hashes[at] == h
                at, end = at[real], end[real] + base
                ends.append(end)
                starts.append(end - n)
                ids.append(pieces.ids[at].astype(np.int64))
                scores.append(pieces.scores[at])
    ends, starts, ids, scores = map(np.concatenate, (ends, starts, ids, scores))
    plain = np.concatenate((np.ones(size, bool), np.zeros(len(ends) - size, bool)))  # byte pieces stand last
    order = np.lexsort((plain, starts, ends))
    bounds = np.searchsorted(ends[order], np.arange(size + 2))
    return bounds.tolist(), starts[order].tolist(), ids[order].tolist(), scores[order].tolist()


def _short_lattice(chunk: bytes, pieces: Pieces) -> tuple[list[int], list[int], list[int], list[float]]:
    """The same for a short chunk, by looking up its substrings."""
    size, table, longest = len(chunk), pieces.table, pieces.longest
    bounds, starts, ids, scores = [0, 0], [], [], []
    for end in range(1, size + 1):
        for start in range(max(0, end - longest), end):
            if hit := table.get(chunk[start:end]):
                starts.append(start)
                ids.append(hit[0])
                scores.append(hit[1])
        last = chunk[end - 1]
        starts.append(end - 1)
        ids.append(int(pieces.byte_ids[0x20 if last == SPACE else last]))
        scores.append(pieces.byte_score)
        bounds.append(len(starts))
    return bounds, starts, ids, scores


def segmentations(chunk: bytes, n: int, pieces: Pieces) -> list[tuple[float, tuple[int, ...]]]:
    """The n best (score, ids) of a chunk in order, by A* from its end.

    The forward scores are exact, so a place is left by its n best ways at most and more are never needed: work grows
    with the chunk's length, whatever it holds. Of equal scores the path that is nearest to the start goes on first.
    """
    size = len(chunk)
    bounds, starts, ids, scores = _lattice(chunk, pieces)
    forward = [0.0] * (size + 1)
    for end in range(1, size + 1):
        best = -np.inf
        for e in range(bounds[end], bounds[end + 1]):
            got = forward[starts[e]] + scores[e]
            if got > best:
                best = got
        forward[end] = best
    out: list[tuple[float, tuple[int, ...]]] = []
    left = [n] * (size + 1)  # ways from each place to the end that are still of use
    # (cost, place, count, score from the place on, the edge taken and what follows it)
    queue: list[tuple[float, int, int, float, tuple | None]] = [(-forward[size], size, 0, 0.0, None)]
    count = 0
    while queue and len(out) < n:
        f, at, _, got, path = heapq.heappop(queue)
        if at == 0:
            found = []
            while path is not None:
                found.append(path[0])
                path = path[1]
            out.append((-f, tuple(found)))
            continue
        if not left[at]:
            continue
        left[at] -= 1
        for e in range(bounds[at], bounds[at + 1]):
            start = starts[e]
            if left[start]:
                count += 1
                heapq.heappush(queue, (-(got + scores[e] + forward[start]), start, count, got + scores[e], (ids[e], path)))
    return out


@lru_cache(1 << 14)  # of chunks up to LONG bytes
def _cached(chunk: bytes, n: int) -> list[tuple[float, tuple[int, ...]]]:
    return segmentations(chunk, n, _current)


# --- many chunks ------------------------------------------------------------------------------------------------------


def _viterbi(rows: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score, loss of the second best, ids at their first bytes or -1, whether) of chunks, padded to one width."""
    count, width = rows.shape
    byte_id = np.zeros(256, np.int32)
    byte_id[: len(pieces.byte_ids)] = pieces.byte_ids
    byte_id[SPACE] = pieces.byte_ids[0x20]
    hashed = np.zeros((width + 1, count), np.uint64)
    for i in range(width):
        hashed[i + 1] = hashed[i] * _P + (rows[:, i].astype(np.uint64) + U64(1))
    power = [U64(1)]
    for _ in range(min(width, pieces.longest)):
        power.append(U64(int(power[-1]) * int(_P) & 0xFFFFFFFFFFFFFFFF))
    forward = np.full((width + 1, count), -np.inf)
    forward[0] = 0
    back_size, back_id = np.zeros((width + 1, count), np.int16), np.zeros((width + 1, count), np.int32)
    edges: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = []
    for end in range(1, width + 1):
        own = []
        live = np.flatnonzero(sizes >= end)
        top = hashed[end, live]
        for size in range(min(end, pieces.longest), 0, -1):
            h = top - hashed[end - size, live] * power[size]
            hit = np.flatnonzero(pieces.maybe[pieces.place(h)])
            if not len(hit):
                continue
            h = h[hit]
            at = np.minimum(np.searchsorted(pieces.hashes, h), len(pieces.hashes) - 1)
            real = pieces.hashes[at] == h
            if real.any():
                own.append((size, live[hit[real]], pieces.ids[at[real]], pieces.scores[at[real]]))
        own.append((1, live, byte_id[rows[live, end - 1]], np.full(len(live), pieces.byte_score)))
        for size, at, ids, scores in own:
            got = forward[end - size, at] + scores
            better = got > forward[end, at]
            at = at[better]
            forward[end, at], back_size[end, at], back_id[end, at] = got[better], size, ids[better]
        edges.append(own)
    each = np.arange(count)
    backward = np.full((width + 1, count), -np.inf)
    backward[sizes, each] = 0
    for end in range(width, 0, -1):
        for size, at, _, scores in edges[end - 1]:
            np.maximum.at(backward, (end - size, at), scores + backward[end, at])
    best_id = np.full((count, width), -1, np.int32)
    place = sizes.astype(np.int64).copy()
    own_rows = each
    while len(own_rows):
        size = back_size[place, own_rows]
        ids = back_id[place, own_rows]
        place = place - size
        best_id[own_rows, place] = ids
        more = place > 0
        own_rows, place = own_rows[more], place[more]
    best = forward[sizes, each]
    second = np.full(count, -np.inf)
    for end in range(1, width + 1):
        for size, at, ids, scores in edges[end - 1]:
            on = (best_id[at, end - size] == ids) & _ends(best_id, at, end - size, end, sizes)
            at, rest = at[~on], (forward[end - size, at] + scores + backward[end, at])[~on]
            np.maximum.at(second, at, rest)
    return best, best - second, best_id, best_id >= 0


def _ends(best_id: np.ndarray, at: np.ndarray, start: int, end: int, sizes: np.ndarray) -> np.ndarray:
    """Whether the best piece at start ends at end: no piece begins between, and one begins at end or the chunk ends."""
    between = (best_id[at, start + 1 : end] < 0).all(axis=1)
    return between & ((sizes[at] == end) | (best_id[at, min(end, best_id.shape[1] - 1)] >= 0))


def _chunks(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with marks, chunk starts, chunk ends, bounds of texts in chunks)."""
    data, offsets = T.column_bytes(column)
    filled = np.diff(offsets) > 0
    out = np.empty(len(data) + int(filled.sum()), np.uint8)
    shifted = offsets + np.concatenate(([0], np.cumsum(filled)))
    marks = shifted[:-1][filled]
    plain = np.ones(len(out), bool)
    plain[marks] = False
    out[plain] = np.where(data == 0x20, SPACE, data)
    out[marks] = SPACE
    space = out == SPACE
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[marks] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(out)) if len(starts) else starts
    return out, starts, ends, np.searchsorted(starts, shifted)


class Known:
    """Best segmentations of the most frequent chunks so far, by hash; of a bounded number."""

    def __init__(self):
        self.hashes, self.score, self.loss = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        self.counts, self.at, self.ids = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.often = np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are known, their places)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[place] == hashes
        return hit, place[hit]

    def learn(self, hashes: np.ndarray, often: np.ndarray, batch: _Batch) -> None:
        """Adds a batch's short chunks (hashes ascend), and keeps the most frequent of all."""
        able = np.flatnonzero(batch.sizes <= LONG)
        hit, place = self.find(hashes[able])
        self.often[place] += often[able[hit]]
        able = able[~hit]
        every = np.concatenate((self.hashes, hashes[able]))
        often = np.concatenate((self.often, often[able]))
        score, loss = np.concatenate((self.score, batch.score[able])), np.concatenate((self.loss, batch.loss[able]))
        counts, at = np.concatenate((self.counts, batch.counts[able])), np.concatenate((self.at[:-1], batch.at[able] + len(self.ids)))
        ids = np.concatenate((self.ids, batch.ids))
        keep = np.arange(len(every)) if len(every) <= KNOWN else np.argpartition(-often, KNOWN - 1)[:KNOWN]
        keep = keep[np.argsort(every[keep])]
        self.hashes, self.often, self.score, self.loss, self.counts = every[keep], often[keep], score[keep], loss[keep], counts[keep]
        self.ids = ids[_ranges(at[keep], self.counts)]
        self.at = np.concatenate(([0], np.cumsum(self.counts)))


class _Batch:
    """All chunks of some texts, each distinct one segmented once."""

    def __init__(self, column: pa.Array, pieces: Pieces, n_best: int = N, known: Known | None = None):
        self.data, self.starts, self.ends, self.bounds = _chunks(column)
        sizes = self.ends - self.starts
        h = T.hash_spans(self.data, self.starts, self.ends)
        names, first, self.of = np.unique(h, return_index=True, return_inverse=True)
        known = known or Known()
        hit, place = known.find(names)
        self.first = first
        own = sizes[first]
        n = len(first)
        self.score, self.loss, counts = np.zeros(n), np.full(n, np.inf), np.zeros(n, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.score[hit], self.loss[hit], counts[hit] = known.score[place], known.loss[place], known.counts[place]
        parts.append((np.flatnonzero(hit), known.ids[_ranges(known.at[place], known.counts[place])]))
        order = np.flatnonzero(~hit)
        order = order[np.argsort(own[order], kind="stable")]
        at, short = 0, int(np.count_nonzero(own[order] <= LONG))
        self.long: dict[int, list[tuple[float, tuple[int, ...]]]] = {}
        for i in order[short:].tolist():
            found = self.long[i] = segmentations(self.chunk(int(first[i])), n_best, pieces)
            self.score[i], self.loss[i] = found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf
            counts[i] = len(found[0][1])
            parts.append((np.array([i]), np.array(found[0][1], np.int32)))
        while at < short:
            width = int(own[order[at]])
            to = min(short, int(np.searchsorted(own[order], width + max(1, width // 4), "right")))
            to = max(at + 1, min(to, at + max(1, (1 << 18) // (width + 4))))
            pick = order[at:to]
            width = int(own[pick].max())
            place = self.starts[first[pick]][:, None] + np.arange(width)
            inside = np.arange(width) < own[pick][:, None]
            rows = np.where(inside, self.data[np.minimum(place, len(self.data) - 1)], PAD).astype(np.uint8)
            self.score[pick], self.loss[pick], ids, has = _viterbi(rows, own[pick], pieces)
            counts[pick] = has.sum(1)
            parts.append((pick, ids[has]))
            at = to
        self.counts, self.sizes = counts, own
        self.at = np.concatenate(([0], np.cumsum(counts)))
        self.ids = np.empty(self.at[-1], np.int32)
        for pick, ids in parts:
            self.ids[_ranges(self.at[pick], counts[pick])] = ids
        known.learn(names, np.bincount(self.of, minlength=n), self)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of texts in ids)."""
        counts = self.counts[self.of]
        total = np.concatenate(([0], np.cumsum(counts)))
        return self.ids[_ranges(self.at[self.of], counts)], total[self.bounds]

    def chunk(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.cumsum(counts)
    return np.repeat(starts - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)


def _alternatives(batch: _Batch, a: int, b: int, n: int) -> list[dict]:
    """The 2nd to n-th best segmentations of the text with chunks a .. b, as edits of the best."""
    loss = batch.loss[batch.of[a:b]]
    k = min(n - 1, b - a)
    pick = np.argpartition(loss, k - 1)[:k] if k < b - a else np.arange(b - a)
    limit = loss[pick].max()
    under = np.flatnonzero(loss < limit)
    pick = np.sort(np.concatenate((under, np.flatnonzero(loss == limit)[: k - len(under)])))
    before = np.concatenate(([0], np.cumsum(batch.counts[batch.of[a:b]])))
    found: list[tuple[float, tuple]] = [(0.0, ())]
    for c in pick.tolist():
        word = int(batch.of[a + c])
        own = batch.long[word] if word in batch.long else _cached(batch.chunk(a + c), n)
        best = own[0][0]
        chosen = tuple(batch.ids[batch.at[word] : batch.at[word + 1]].tolist())  # one of those that share the best score
        others = [(max(0.0, best - s), ids) for s, ids in own if ids != chosen][: n - 1]
        options = [(0.0, ())] + [(x, ((int(before[c]), int(before[c + 1] - before[c]), ids),)) for x, ids in others]
        found = sorted(((x + y, p + q) for x, p in found for y, q in options), key=lambda z: z[0])[:n]
    return [{"rank": r + 2, "loss": float(x), "edits": [{"at": at, "drop": drop, "ids": list(ids)} for at, drop, ids in edits]} for r, (x, edits) in enumerate(found[1:])]


ENCODED = "ids array<int>, n_tokens long, score double, alternatives array<struct<rank:int,loss:double,edits:array<struct<at:int,drop:int,ids:array<int>>>>>, round_trip boolean"
_EDIT = pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))]))
_ALTERNATIVES = pa.list_(pa.struct([("rank", pa.int32()), ("loss", pa.float64()), ("edits", _EDIT)]))


def encode_column(column: pa.Array, pieces: Pieces, n: int = N, known: Known | None = None) -> list[pa.Array]:
    """The columns of ENCODED but the last. known: what was learnt from the texts before; it doesn't change results."""
    global _current
    if _current is not pieces:
        _current = pieces
        _cached.cache_clear()
    batch = _Batch(column, pieces, max(2, n), known)
    ids, at = batch.tokens()
    null = np.array([column.is_null().to_numpy(zero_copy_only=False)]).reshape(-1)
    score = np.zeros(len(column))
    filled = np.flatnonzero(np.diff(batch.bounds))
    if len(filled):
        score[filled] = np.add.reduceat(batch.score[batch.of], batch.bounds[filled])
    more = [_alternatives(batch, int(a), int(b), n) if b > a and n > 1 else [] for a, b in zip(batch.bounds[:-1], batch.bounds[1:], strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(null))
    return [lists, pa.array(np.diff(at), pa.int64()), pa.array(score), pa.array(more, _ALTERNATIVES)]


def encode(docs: DataFrame, pieces: Pieces | None = None, n: int = N) -> DataFrame:
    """(doc_id, ids, n_tokens, score, alternatives, round_trip) for each row of docs: the best segmentation, edits that
    turn its ids into those of the next best (at, drop: ids that the new ones replace), and whether ids decode to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces or load())  # a vocabulary: some MB
    names = ["doc_id", "ids", "n_tokens", "score", "alternatives", "round_trip"]

    def run(batches):
        known = Known()
        for batch in T.pieces_of(batches, limit=1 << 21):
            text = batch.column("text")
            columns = encode_column(text, shared.value, n, known)
            back = decode_column(columns[0], shared.value)
            same = pc.fill_null(pc.equal(text, back), False)  # null comes back as null
            yield pa.record_batch([batch.column("doc_id"), *columns, pc.or_(same, pc.and_(text.is_null(), back.is_null()))], names)

    return T.bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {ENCODED}")


def edited(ids: list[int], edits: list[dict]) -> list[int]:
    out, at = [], 0
    for e in sorted(edits, key=lambda e: e["at"]):
        out += ids[at : e["at"]] + list(e["ids"])
        at = e["at"] + e["drop"]
    return out + ids[at:]


def decode(ids: list[int] | None, pieces: Pieces) -> str | None:
    """The text of ids; exact for those that `encode` returns."""
    if ids is None:
        return None
    raw = b"".join(pieces.text[i] for i in ids)
    return raw.replace(bytes([SPACE]), b" ")[1:].decode("utf-8", "replace")


def decode_column(column: pa.Array, pieces: Pieces) -> pa.Array:
    """`decode` for a column of ids."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = pieces.plain.take(column.flatten())
    if found.null_count:
        raise ValueError("an id has no text")
    _, offsets, data = found.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(found) + 1) if len(found) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[: offsets[-1]] if data else np.zeros(0, np.uint8)
    ends = offsets[np.concatenate(([0], np.cumsum(sizes)))]
    first = ends[:-1][np.diff(ends) > 0]  # the mark in front of each text
    kept = np.ones(len(data), bool)
    kept[first] = False
    data, ends = data[kept], ends - np.concatenate(([0], np.cumsum(np.diff(ends) > 0)))
    null = column.is_null().to_numpy(zero_copy_only=False)
    valid = pa.py_buffer(np.packbits(~null, bitorder="little")) if null.any() else None
    text = pa.Array.from_buffers(pa.large_string(), len(column), [valid, pa.py_buffer(ends), pa.py_buffer(data)])
    try:
        text.validate(full=True)
    except pa.ArrowInvalid:  # ids that aren't those of a text
        at, raw = ends.tolist(), data.tobytes()
        text = pa.array([None if x else raw[a:b].decode("utf-8", "replace") for x, a, b in zip(null.tolist(), at[:-1], at[1:], strict=True)], pa.large_string())
    return text.cast(pa.string())


def decoded(rows: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """(doc_id, text) for each row of a table of ids (doc_id, ids)."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces or load())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.record_batch([part.column("doc_id"), decode_column(part.column("ids"), shared.value)], ["doc_id", "text"])

    return T.bounded(rows).select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
