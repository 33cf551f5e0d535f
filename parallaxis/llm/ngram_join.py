"""N-gram Jaccard self-join: T-occurrence search with DivideSkip, cut into shuffles.

A document's set holds its distinct 5-word shingles as 64-bit hashes; two documents link when the Jaccard similarity of
their sets is at least 80 %. Steps, each linear in the input except where documents really resemble each other:

1. Documents of equal sets form a class, named by a 64-bit digest of the set. From here on only classes are compared.
2. The document frequency of every shingle is counted (packed, summed map-side and by bucket). Inverted lists of at
   least `heavy` documents are the *long lists* of DivideSkip; the `table` longest are known to all tasks, a fixed size.
3. Linked sets overlap in at least ceil(0.8 n) shingles, so a set may set aside that many shingles less one; it sets
   aside those of the longest lists. Only the remaining n - ceil(0.8 n) + 1 are sent to the inverted lists.
4. The sets of the classes that share a list with another are written once. In a first round each class is compared with
   the leader that most of its lists name. In later rounds a T-occurrence search over the lists that were sent names for
   each class the one of another component that shares the most of them, as long as that joins components. Lists whose
   members all belong to one component need nothing more.
5. What is left is searched whole: the same search names all other components that have a class with as many shared
   lists as a link needs, and the class is searched for in these components.

Every search is a T-occurrence search by DivideSkip: short inverted lists are heap-merged with skips (or, where they
hold many ids, merged by a sort), long ones are probed by binary search, and candidates that reach the required overlap
link. One link joins a class to a whole
component, so a search ends with the first.

Digests and shingles of 64 bits: of n classes, about n*n/2**65 pairs are wrongly merged (3e10 documents: some 20).

Results for odd input: null or empty texts have an empty set, size 0, and are their own component; a text of fewer than
five words has one shingle; equal texts always share a component; rows with a null doc_id take part in links, and a
component of only such rows has a null id; repeated rows are one class; other columns are ignored by `join` and kept by
`dedupe`; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import Scratch, connected_components, save, tidy
from . import _text as T

WORDS = 5
PERCENT = 80
HEAVY = 16  # lists of so many documents are long
TABLE = 1 << 19  # long lists known to all tasks, at most: 16 bytes each
FLUSH = 1 << 19  # shingles that a map task packs at once
HEAPED = 512  # ids merged on a heap at most
CELL = 64  # queries that one cell searches for a leader
BLOCK = 256  # classes that one block indexes
ROUNDS = 6
GAIN = 10  # rounds end when less than one in so many queries finds a link
INDEX = 1 << 19  # entries of inverted lists that one cell indexes
PIECE = 1 << 18  # entries of the queries that one cell searches for
EXPANDED = 1 << 20  # ids that are merged at once
NARROW = 1_000_000  # ids broadcast at most: 16 bytes each if they are numbers

U64 = np.uint64


def need(a: int, b: int, percent: int = PERCENT) -> int:
    """The least overlap of sets of a and b shingles for a similarity of percent."""
    return -(-percent * (a + b) // (100 + percent))


def digests(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set; sizes count, so an empty set has one too."""
    sizes = np.diff(bounds)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(T.mix(sets ^ U64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    return T.mix(total[bounds[1:]] - total[bounds[:-1]] + sizes.astype(np.uint64) * U64(0x2545F4914F6CDD1D))


def _sets(batches, k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in T.pieces_of(batches):
        words, bounds = T.word_hashes(batch.column(batch.schema.get_field_index("text")), T.SPACED)
        yield batch, *T.shingle_sets(words, bounds, k)


# --- 1: classes -------------------------------------------------------------------------------------------------------


def sized(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, node): the size of each row's set, and its class."""

    def run(batches):
        for batch, sets, bounds in _sets(batches, k):
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(digests(sets, bounds).view(np.int64))], ["doc_id", "n_shingles", "node"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, node long")


# --- 2: long lists ----------------------------------------------------------------------------------------------------


def _packed(bits: int, keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """One row for each bucket (the top bits of the key) of ascending keys: bucket, then bytes."""
    buckets = (keys >> U64(64 - bits)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(buckets)) + 1, [len(keys)]))
    for a, b in itertools.pairwise(cuts.tolist()):
        yield int(buckets[a]), keys[a:b].tobytes(), *(v[a:b].tobytes() for v in values)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _by_bucket(batches) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Neighbouring rows of one bucket: (bucket, columns of bytes)."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for bucket, own in itertools.groupby(rows, key=lambda r: r[0]):
        yield bucket, [list(c) for c in zip(*own, strict=True)][1:]
    T.release()


def long_lists(docs: DataFrame, bits: int, k: int = WORDS, heavy: int = HEAVY, table: int = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ranks) of the `table` most frequent shingles with `heavy` documents or more; key: the upper 40 bits."""
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def count(batches):
        held, n = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held) >> U64(24), return_counts=True)
            # 40 bits, of which the bucket has `bits`: 32 more at most are sent
            full = keys << U64(24)
            low = ((keys << U64(bits + 24)) >> U64(32)).astype(np.uint32)
            rows = [(b, low_bytes, c) for (b, _, low_bytes, c) in _packed(bits, full, low, counts.astype(np.uint32))]
            return _rows(schema, rows)

        for _, sets, _ in _sets(batches, k):
            held.append(sets)
            n += len(sets)
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def total(batches):
        for bucket, (keys, counts) in _by_bucket(batches):
            low = np.frombuffer(b"".join(keys), np.uint32)
            many = np.frombuffer(b"".join(counts), np.uint32)
            order = np.argsort(low, kind="stable")
            low, many = low[order], many[order]
            first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            sums = np.add.reduceat(many.astype(np.int64), first)
            kept = sums >= heavy
            key = (U64(bucket) << U64(64 - bits)) | (low[first][kept].astype(np.uint64) << U64(32 - bits))
            if len(key):
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(sums[kept])], ["key", "n"])

    packed = docs.select("text").mapInArrow(count, "bucket int, keys binary, counts binary")
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(total, "key long, n long").orderBy(F.desc("n"), "key").limit(table).toArrow()
    keys = found.column("key").to_numpy().view(np.uint64) >> U64(24)
    order = np.argsort(keys)
    rank = np.arange(len(keys), 0, -1, dtype=np.int32)  # the most frequent last
    return keys[order], rank[order]


class Frequencies:
    """Ranks of shingles in the global order: 0 for short lists, higher for longer ones."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.keys, self.ranks = keys, ranks
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(keys >> U64(18)).astype(np.int64)] = True

    def of(self, shingles: np.ndarray) -> np.ndarray:
        out = np.zeros(len(shingles), np.int32)
        if len(self.keys):
            at = np.flatnonzero(self.maybe[(shingles >> U64(42)).astype(np.int64)])
            key = shingles[at] >> U64(24)
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[at] = np.where(self.keys[place] == key, self.ranks[place], 0)
        return out


# --- 3: inverted lists ------------------------------------------------------------------------------------------------


def _prefixes(sets: np.ndarray, bounds: np.ndarray, ranks: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, short-list shingles, long-list shingles) to send for each set that isn't empty."""
    some = np.concatenate(([0], np.cumsum(ranks > 0)))
    for i in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[i], bounds[i + 1]
        n = int(b - a)
        p = n + (-percent * n // 100) + 1
        own = sets[a:b]
        if some[a] == some[b]:
            yield i, own[:p], own[:0]
            continue
        r = ranks[a:b]
        short = own[r == 0][:p]
        rest = p - len(short)
        if rest:
            at = np.flatnonzero(r)
            yield i, short, own[at[np.argsort(r[at], kind="stable")[:rest]]]
        else:
            yield i, short, own[:0]


LIST = "token long, node long, size int"
LIST_NAMES = ("token", "node", "size")


def lists(docs: DataFrame, frequencies: Frequencies, bits: int, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(token, node, size): members of inverted lists that have two classes or more.

    Members of long lists come each by itself, even alone: such a list may hold a third of all documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)
    schema = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in ("tokens", "nodes", "sizes", "long"))])

    def send(batches):
        held, n = [], 0
        turn = 0

        def flush():
            token, node, size, is_long = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((node, token))
            token, node, size, is_long = token[order], node[order], size[order], is_long[order]
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
            token, node, size, is_long = token[new], node[new], size[new], is_long[new]
            rows = list(_packed(bits, token[~is_long], node[~is_long], size[~is_long]))
            rows = [(*r, b"") for r in rows] if (~is_long).any() else []
            if is_long.any():
                rows.append(((1 << bits) + (turn * 7919) % (1 << bits), b"", node[is_long].tobytes(), size[is_long].tobytes(), token[is_long].tobytes()))
            return _rows(schema, rows)

        for _, sets, bounds in _sets(batches, k):
            nodes, sizes = digests(sets, bounds), np.diff(bounds).astype(np.int32)
            for i, short, long in _prefixes(sets, bounds, shared.value.of(sets), percent):
                m = len(short) + len(long)
                held.append((np.concatenate((short, long)), np.full(m, nodes[i]), np.full(m, sizes[i]), np.arange(m) >= len(short)))
                n += m
                if n >= FLUSH:
                    yield flush()
                    held, n, turn = [], 0, turn + 1
        if n:
            yield flush()

    def gather(batches):
        for bucket, (tokens, nodes, sizes, longs) in _by_bucket(batches):
            node, size = np.frombuffer(b"".join(nodes), np.uint64), np.frombuffer(b"".join(sizes), np.int32)
            if bucket >= 1 << bits:
                token = np.frombuffer(b"".join(longs), np.uint64)
                yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(node.view(np.int64)), pa.array(size)], ["token", "node", "size"])
                continue
            token = np.frombuffer(b"".join(tokens), np.uint64)
            order = np.lexsort((node.view(np.int64), token))
            token, node, size = token[order], node[order].view(np.int64), size[order]
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
            token, node, size = token[new], node[new], size[new]
            first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            many = np.diff(np.concatenate((first, [len(token)])))
            kept = np.repeat(many > 1, many)
            if kept.any():
                yield pa.record_batch([pa.array(token[kept].view(np.int64)), pa.array(node[kept]), pa.array(size[kept])], ["token", "node", "size"])

    packed = docs.select("text").mapInArrow(send, "bucket int, tokens binary, nodes binary, sizes binary, long binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, LIST)


# --- 4: T-occurrence search -------------------------------------------------------------------------------------------


def divide_skip(inverted: list[list[int]], t: int) -> Iterator[tuple[int, int]]:
    """(id, occurrences) of the ids that stand in at least t of the ascending lists, by DivideSkip.

    The longest lists are set aside; the short ones are merged on a heap, skipping ids that cannot reach t, and what
    reaches the remaining threshold there is looked up in the long lists by binary search.
    """
    if t < 1:
        raise ValueError("the threshold is at least 1")
    inverted = sorted((x for x in inverted if x), key=len, reverse=True)
    if len(inverted) < t:
        return
    aside = min(t - 1, int(t / (0.0085 * math.log2(max(2, len(inverted[0]))) + 1)))
    far, near = inverted[:aside], inverted[aside:]
    short = t - aside
    heap = [(x[0], i, 0) for i, x in enumerate(near)]
    heapq.heapify(heap)
    while len(heap) >= short:
        least = heap[0][0]
        popped = []
        while heap and heap[0][0] == least:
            popped.append(heapq.heappop(heap))
        n = len(popped)
        if n >= short:
            for x in far:
                at = bisect_left(x, least)
                n += at < len(x) and x[at] == least
            if n >= t:
                yield least, n
            reach = least + 1
        else:
            while heap and len(popped) < short - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            reach = heap[0][0]
        for _, i, at in popped:
            at = bisect_left(near[i], max(reach, least + 1), at)
            if at < len(near[i]):
                heapq.heappush(heap, (near[i][at], i, at))


def occurrences(inverted: list[np.ndarray], t: int) -> tuple[np.ndarray, np.ndarray]:
    """`divide_skip` for arrays: lists with many ids besides the longest are merged by one stable sort, not on a heap."""
    inverted = sorted((x for x in inverted if len(x)), key=len, reverse=True)
    if len(inverted) < t:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    aside = min(t - 1, int(t / (0.0085 * math.log2(max(2, len(inverted[0]))) + 1)))
    if sum(map(len, inverted[aside:])) <= HEAPED:
        hits = list(divide_skip([x.tolist() for x in inverted], t))
        at, n = np.array(hits, np.int64).reshape(-1, 2).T
        return at, n
    merged = np.sort(np.concatenate(inverted[aside:]), kind="stable")
    first = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
    n = np.diff(np.concatenate((first, [len(merged)])))
    kept = n >= t - aside
    at, n = merged[first[kept]], n[kept]
    for x in inverted[:aside]:
        place = np.minimum(np.searchsorted(x, at), len(x) - 1)
        n = n + (x[place] == at)
    return at[n >= t], n[n >= t]


class Block:
    """Inverted lists of some sets."""

    def __init__(self, names: list[int], sets: list[np.ndarray], percent: int):
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.names, self.percent = [names[i] for i in order], percent
        self.sizes = np.array([len(sets[i]) for i in order])
        tokens = np.concatenate([sets[i] for i in order])
        owner = np.repeat(np.arange(len(order)), self.sizes)
        by = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[by], owner[by]

    def search(self, query: np.ndarray) -> int | None:
        """The name of a set that links with the query, or None."""
        n, p = len(query), self.percent
        least = int(np.searchsorted(self.sizes, -(-p * n // 100)))
        if least == len(self.sizes) or 100 * n < p * self.sizes[least]:
            return None
        lo, hi = np.searchsorted(self.tokens, query, "left"), np.searchsorted(self.tokens, query, "right")
        own = np.flatnonzero(hi > lo)
        t = need(n, int(self.sizes[least]), p)
        if len(own) < t:
            return None
        at, overlap = occurrences([self.owner[a:b] for a, b in zip(lo[own].tolist(), hi[own].tolist(), strict=True)], t)
        linked = at[overlap * (100 + p) >= p * (n + self.sizes[at])]
        return self.names[linked[0]] if len(linked) else None


def candidate_sets(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """(node, items): the sets of classes, read from the one document (doc_id of `reps`) that stands for each.

    Where ids repeat or are null, other classes may come along, or one class twice; neither changes a search.
    """
    wanted = reps.select("doc_id").distinct()
    right = _near(wanted).withColumnRenamed("doc_id", "__rep")
    rows = docs.select("doc_id", "text").join(right, F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi")

    def run(batches):
        for _, sets, bounds in _sets(batches, k):
            yield pa.record_batch([pa.array(digests(sets, bounds).view(np.int64)), pa.array([sets[a:b].tobytes() for a, b in itertools.pairwise(bounds.tolist())], pa.binary())], ["node", "items"])

    return rows.select("text").mapInArrow(run, "node long, items binary")


def _near(ids: DataFrame) -> DataFrame:
    """Ids to join with: broadcast if there are few of them, else as they are."""
    return F.broadcast(ids) if ids.count() <= NARROW else ids


def _cells(batches, key: str = "cell") -> Iterator[dict[str, np.ndarray]]:
    """The columns of each run of rows that share a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in itertools.pairwise(cuts):
            if b > a:
                if held and held[-1].column(held[-1].schema.get_field_index(key))[0].as_py() != keys[a]:
                    yield _joined(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield _joined(held)
    del held
    T.release()


def _joined(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return {c: table.column(c).to_numpy() for c in table.column_names}


def search(sets: DataFrame, members: DataFrame, queries: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """(a, b): for each (cell, node) of queries that links with one of the cell's members, one such link.

    Cells are bounded by their makers; a cell's members are read first, and its queries stream past their index.
    """
    asked = scratch.keep(members.select("cell", F.lit(0).alias("kind"), "node").union(queries.select("cell", F.lit(1).alias("kind"), "node")))
    # few ids go to the sets where these are; only the sets asked for are dealt to cells
    rows = sets.join(_near(asked), "node").select("cell", "kind", "node", "items").repartition("cell").sortWithinPartitions("cell", "kind")

    def run(batches):
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found: list[tuple[int, int]] = []
        for _, own in itertools.groupby(stream, key=lambda r: r[0]):
            names, held, block = [], [], None
            for _, kind, node, items in own:
                one = np.frombuffer(items, np.uint64)
                if kind == 0:
                    names.append(node)
                    held.append(one)
                    continue
                if block is None:
                    if not names:
                        continue
                    block = Block(names, held, percent)
                if (hit := block.search(one)) is not None:
                    found.append((hit, node))
            if len(found) > 10_000:
                yield pa.record_batch([pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])
                found = []
        if found:
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])
        names = held = block = None
        T.release()

    return rows.mapInArrow(run, "a long, b long")


class Prefixes:
    """Inverted lists of what some classes sent: T-occurrence search for classes that can link with any of many queries.

    The lists of a chunk of queries are merged together, by one sort; a chunk expands to EXPANDED ids or one query."""

    def __init__(self, tokens: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, components: np.ndarray, percent: int):
        self.nodes, first, owner = np.unique(nodes, return_index=True, return_inverse=True)
        self.components, self.sizes, self.percent = components[first], sizes[first].astype(np.int64), percent
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]

    def least(self, size: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The least number of lists that sets of two sizes must share to link; more than any has if they can't."""
        p = self.percent
        aside = -(-p * np.maximum(size, other) // 100) - 1
        t = np.maximum(1, -(-p * (size + other) // (100 + p)) - aside)
        return np.where(100 * np.minimum(size, other) >= p * np.maximum(size, other), t, 1 << 40)

    def search(self, tokens: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, components: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, places of classes of other components that share as many lists as a link needs, how many more they
        share), in the queries' order, chunk by chunk. Entries of a query are neighbours."""
        lo, hi = np.searchsorted(self.tokens, tokens, "left"), np.searchsorted(self.tokens, tokens, "right")
        total = np.concatenate(([0], np.cumsum(hi - lo)))
        cuts = np.concatenate(([0], np.flatnonzero(nodes[1:] != nodes[:-1]) + 1, [len(nodes)]))
        rank = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        many = len(self.nodes)
        at = 0
        while at < len(cuts) - 1:
            to = max(at + 1, int(np.searchsorted(total[cuts], total[cuts[at]] + EXPANDED, "right")) - 1)
            own = slice(int(cuts[at]), int(cuts[to]))
            n = (hi - lo)[own]
            place = np.repeat(lo[own] - (total[own] - total[own.start]), n) + np.arange(int(n.sum()))
            key = np.sort(np.repeat(rank[own], n) * many + self.owner[place])
            if len(key):
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                count = np.diff(np.append(first, len(key)))
                query, found = cuts[key[first] // many], key[first] % many
                more = count - self.least(sizes[query].astype(np.int64), self.sizes[found])
                keep = (more >= 0) & (self.components[found] != components[query])
                yield query[keep], found[keep], more[keep]
            at = to


def candidates(entries: DataFrame, best: bool, percent: int = PERCENT, index: int = INDEX, piece: int = PIECE) -> DataFrame:
    """Classes that share as many lists as a link needs, of different components. best: (node, leader) names for each
    class the one with the most such lists; else (node, target) names all components of such classes, and of each two
    classes, one finds the other.

    Entries (token, node, size, component) are dealt to cells of one block of indexed classes and one piece of queries,
    both of bounded size whatever the length of a list; a list goes only to cells where it has members on both sides.
    """
    n = entries.count()
    blocks, pieces = -(-n // index), -(-n // piece)
    placed = entries.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(max(1, blocks)))).withColumn("piece", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(max(1, pieces))))
    where = placed.groupBy("token").agg(F.collect_set("block").alias("blocks"), F.collect_set("piece").alias("pieces"))
    asked = F.transform("blocks", lambda b: F.struct(b.alias("block"), F.col("piece").alias("piece"), F.lit(True).alias("query")))
    held = F.transform("pieces", lambda p: F.struct(F.col("block").alias("block"), p.alias("piece"), F.lit(False).alias("query")))
    dealt = placed.join(where, "token").select("token", "node", "size", "component", F.explode(F.concat(asked, held)).alias("to"))
    rows = dealt.select(F.xxhash64("to.block", "to.piece").alias("cell"), "to.query", "token", "node", "size", "component").repartition("cell").sortWithinPartitions("cell")

    def run(batches):
        for cell in _cells(batches):
            q = cell["query"].astype(bool)
            if q.all() or not q.any():
                continue
            held = Prefixes(*(cell[c][~q] for c in ("token", "node", "size", "component")), percent)
            order = np.flatnonzero(q)[np.argsort(cell["node"][q], kind="stable")]
            token, node, size, component = (cell[c][order] for c in ("token", "node", "size", "component"))
            for query, found, more in held.search(token, node, size, component):
                if best:  # the first of each query in this order; of equals the least node, so that classes agree on one
                    order = np.lexsort((held.nodes[found], -more, query))
                    query, found, more = query[order], found[order], more[order]
                    keep = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else query > 0
                    other = held.nodes[found]
                else:
                    keep = held.nodes[found] > node[query]
                    other = held.components[found]
                pairs = np.stack((node[query[keep]], other[keep], more[keep] if best else np.zeros(int(keep.sum()), np.int64)))
                pairs = pairs if best else np.unique(pairs, axis=1)
                if pairs.shape[1]:
                    yield pa.record_batch([pa.array(c) for c in pairs], ["node", "other", "more"])

    pairs = rows.mapInArrow(run, "node long, other long, more long")
    if not best:
        return pairs.select("node", F.col("other").alias("target")).distinct()
    return pairs.groupBy("node").agg(F.max_by("other", F.struct("more", F.bitwise_not(F.col("other")))).alias("leader"))


# --- 5: links and components ------------------------------------------------------------------------------------------


def _fits(a: str, b: str, percent: int):
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _with_component(rows: DataFrame, component: DataFrame | None) -> DataFrame:
    if component is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(component.withColumnRenamed("component", "__c"), "node", "left").withColumn("component", F.coalesce("__c", "node")).drop("__c")


def _open(rows: DataFrame, component: DataFrame | None, alive: DataFrame | None = None) -> DataFrame:
    """The members (of classes in `alive`) of lists that hold several components, with theirs."""
    rows = rows.select(*LIST_NAMES)
    if alive is not None:
        rows = rows.join(_near(alive.select("node")), "node", "left_semi")
    placed = _with_component(rows, component)
    several = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    return placed.join(several, "token")


def _least_shared(their_size: str, percent: int):
    """The least number of lists that sets of two sizes must share to link: sets that share n of the shingles sent
    overlap in n + max(rest) at most, where the rest of a set is what it set aside."""
    size, other = F.col("size"), F.col(their_size)
    aside = lambda x: F.ceil(F.lit(percent) * x / 100) - 1
    return F.greatest(F.lit(1), F.ceil(F.lit(percent) * (size + other) / (100 + percent)) - F.greatest(aside(size), aside(other)))


def _merged(component: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components after some more links: whole components are the nodes of the graph, so it shrinks from round to round."""
    ends = _with_component(links.select(F.col("a").alias("node"), "b"), component).select("b", F.col("component").alias("u"))
    ends = _with_component(ends.select(F.col("b").alias("node"), "u"), component).select("u", F.col("component").alias("v"))
    now = connected_components(ends, "u", "v", scratch)
    if component is None:
        return now
    moved = now.select(F.col("node").alias("component"), F.col("component").alias("__to"))
    old = component.join(moved, "component", "left").select("node", F.coalesce("__to", "component").alias("component"))
    return scratch.keep(old.unionByName(now.join(component.select("node"), "node", "left_anti")))


def components(docs: DataFrame, members: DataFrame, reps: DataFrame, scratch: Scratch, k: int = WORDS, percent: int = PERCENT) -> DataFrame | None:
    """(node, component) of the classes that link with another; None if there is no link. members: of inverted lists
    (LIST); reps: (node, doc_id) of all classes."""
    rows = scratch.keep(members)
    if not rows.limit(1).count():
        return None
    sets = scratch.keep(candidate_sets(docs, reps.join(rows.select("node").distinct(), "node"), k))
    component: DataFrame | None = None
    best: DataFrame | None = None  # classes that have a candidate; the others have none in later rounds either
    for turn in range(ROUNDS):
        now = scratch.keep(_open(rows, component, best))
        scratch.drop(rows, best)
        rows = now
        best = scratch.keep(candidates(rows, True, percent) if turn else _leaders(rows, percent))
        tried = best.count()
        if tried:
            counts = best.groupBy("leader").agg(F.ceil(F.count("*") / CELL).alias("cells"))
            cells = best.join(counts, "leader").withColumn("cell", F.xxhash64("leader", F.pmod(F.xxhash64("node"), F.col("cells"))))
            new = scratch.keep(search(sets, cells.select("cell", F.col("leader").alias("node")).distinct(), cells.select("cell", "node"), scratch, percent))
            got = new.count()
            if got:
                component = _replaced(component, _merged(component, new, scratch), scratch)
            scratch.drop(new)
        if turn == 0:  # leaders are a choice, not all candidates
            best = _replaced(best, None, scratch)
        elif not tried or got * GAIN < tried:
            break
    end = scratch.keep(_open(rows, component, best))
    scratch.drop(rows, best)
    asks = scratch.keep(candidates(end, False, percent))
    if asks.limit(1).count():
        # a cell holds part of one component, so that one link is enough for each query
        nodes = end.select(F.col("component").alias("target"), "node").distinct()
        cuts = asks.groupBy("target").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("pieces"))
        cuts = scratch.keep(nodes.groupBy("target").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(cuts, "target"))
        cell = F.xxhash64("target", "block", "piece")
        block, piece = (F.pmod(F.xxhash64("node", F.lit(i)), F.col(c)).cast("int") for i, c in enumerate(("blocks", "pieces")))
        members = nodes.join(cuts, "target").select("target", "node", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        queries = asks.join(cuts, "target").select("target", "node", piece.alias("piece"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        new = scratch.keep(search(sets, members.select(cell.alias("cell"), "node"), queries.select(cell.alias("cell"), "node"), scratch, percent))
        if new.limit(1).count():
            component = _replaced(component, _merged(component, new, scratch), scratch)
    scratch.drop(sets, asks, end)
    return component


def _leaders(rows: DataFrame, percent: int) -> DataFrame:
    """(node, leader): for each class the list leader that most of its lists name, if these are enough for a link.

    A list's leader is the member with the least hash; partial minima keep a frequent list from meeting in one task.
    """
    leader = F.min_by(F.struct(F.col("node").alias("leader"), F.col("size").alias("their_size"), F.col("component").alias("theirs")), F.xxhash64("node"))
    lead = rows.groupBy("token").agg(leader.alias("l")).select("token", "l.*")
    votes = rows.join(lead, "token").where((F.col("component") != F.col("theirs")) & _fits("size", "their_size", percent)).groupBy("node", "size", "leader", "their_size").agg(F.count("*").alias("n"))
    likely = votes.where(F.col("n") >= _least_shared("their_size", percent))
    return likely.groupBy("node").agg(F.max(F.struct("n", "leader")).alias("best")).select("node", "best.leader")


def _replaced(old: DataFrame | None, new: DataFrame | None, scratch: Scratch) -> DataFrame | None:
    scratch.drop(old)
    return new


def join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, heavy: int = HEAVY, table: int = TABLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs; component_id: the least doc_id reachable by links."""
    with tidy(docs.sparkSession):
        return _join(docs, k, percent, heavy, table)


def _join(docs: DataFrame, k: int, percent: int, heavy: int, table: int) -> DataFrame:
    scratch = Scratch(T.bounded(docs).sparkSession)
    try:
        rows = scratch.keep(sized(docs, k))
        total = rows.agg(F.sum("n_shingles")).first()[0] or 0
        classes = scratch.keep(rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
        bits = max(8, min(24, (total >> 20).bit_length()))
        frequencies = Frequencies(*long_lists(docs, bits, k, heavy, table))
        component = components(docs, lists(docs, frequencies, bits, k, percent), classes, scratch, k, percent)
        if component is None:
            ids = classes.select("node", F.col("doc_id").alias("component_id"))
        else:
            placed = classes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
            least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
            ids = placed.join(least, "component").select("node", "component_id")
        some = rows.where("n_shingles > 0").join(ids, "node").select("doc_id", "n_shingles", "component_id")
        none = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return save(some.unionByName(none))
    finally:
        scratch.clear()


def dedupe(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is its component's least: one document of each group. Rows that share a doc_id
    and a text count as one; rows without a doc_id stay."""
    docs = docs if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() == 0 else docs.dropDuplicates(["doc_id", "text"])
    gone = join(docs, k, percent).where("doc_id != component_id").select("doc_id").distinct()
    n = gone.count()
    return docs.join(F.broadcast(gone) if n <= NARROW else gone.hint("merge"), "doc_id", "left_anti")
