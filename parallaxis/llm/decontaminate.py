"""Benchmark decontamination by winnowing.

A benchmark window is 13 consecutive words of an item (a shorter item is one window). Texts and items are
fingerprinted alike: of every run of `w` consecutive k-gram hashes the least is kept, with k + w - 1 = 13, so any
two texts that share 13 words keep a common fingerprint inside the shared span. A fingerprint that meets one of the
benchmark is extended: each window of the document that holds it is looked up among the windows of the items, and the
windows found mark their words as hit. Items of fewer words form classes of their own with k + w - 1 = their length, so
they are found just as surely. Windows that an item repeats count once, so rows of one word cost no more than others.

Results for odd input: a null or empty text has no words and is never contaminated; items without words, with a null
text or a null id find nothing; items that share an id count once; repeated documents are judged one by one; an empty
benchmark hits nothing; columns beyond those named are ignored by `scan` and passed through by `clean`, whatever their
names; texts of any length are used whole.

The words of the items are hashed where the benchmark is. If there are at most `block_words` of them (their index: some 40
bytes each), all tasks get the index. Beyond that the fingerprints of documents and items are joined, each document
meets the items that share one, an item at a time, and nothing of the benchmark goes through the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import save
from . import _text as T

WINDOW_WORDS = 13
GRAM = 5
BLOCK_WORDS = 2_000_000
SHARE = 20  # contaminated: SHARE * hit words >= words

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_FOUND = "array<struct<start:int,stop:int,item:string>>"


def least_in_windows(h: np.ndarray, w: int) -> np.ndarray:
    """Which places hold the least hash of some w consecutive ones (ties: all of them)."""
    if len(h) < w:
        return np.zeros(len(h), bool)

    def slide(x: np.ndarray, pick) -> np.ndarray:  # the pick over w neighbours, by doubling
        width = 1
        while width < w:
            step = min(width, w - width)
            x = pick(x[:-step], x[step:])
            width += step
        return x

    least = slide(h, np.minimum)
    padded = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    return slide(padded, np.maximum) == h


def grams_at(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """`T.grams` for the runs of k words that begin at some places."""
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h *= np.uint64(0xA0761D6478BD642F)
        h += words[at + j]
    return T.mix(h ^ np.uint64(k))


def fingerprints(words: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Places of the fingerprints of some words for windows of a length."""
    k = min(gram, length)
    return np.flatnonzero(least_in_windows(T.grams(words, k), length - k + 1))


class Index:
    """Fingerprints and windows of some benchmark items, by class of window length."""

    def __init__(self, ids: list[str], words: list[np.ndarray], window: int, gram: int):
        self.ids, self.gram = ids, gram
        self.classes = []
        for length in sorted({min(window, len(x)) for x in words if len(x)}):
            own = [i for i, x in enumerate(words) if min(window, len(x)) == length]
            k = min(gram, length)
            prints = np.unique(np.concatenate([T.grams(words[i], k)[fingerprints(words[i], length, gram)] for i in own]))
            windows = [np.unique(T.grams(words[i], length)) for i in own]
            items, windows = np.repeat(own, [len(x) for x in windows]), np.concatenate(windows)
            order = np.lexsort((items, windows))
            items, windows = items[order], windows[order]
            first = np.flatnonzero(np.concatenate(([True], windows[1:] != windows[:-1])))
            self.classes.append((length, k, prints, windows[first], np.append(first, len(windows)), items))

    def scan(self, words: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, str]]]:
        """For each text with a hit: (first word, past the last word, item id) of its maximal runs of hit words."""
        found: dict[int, list[tuple[int, int, str]]] = {}
        for length, k, prints, windows, cuts, items in self.classes:
            g = T.grams(words, k)
            if not len(g):
                continue
            # windows that straddle two texts may keep needless fingerprints; those inside a text keep theirs
            at = np.flatnonzero(least_in_windows(g, length - k + 1))
            at = at[prints[np.minimum(np.searchsorted(prints, g[at]), len(prints) - 1)] == g[at]]
            if not len(at):
                continue
            starts = np.unique((at[:, None] - np.arange(length - k + 1)).ravel())
            text = np.searchsorted(bounds, starts, "right") - 1
            inside = (starts >= 0) & (text >= 0) & (starts + length <= bounds[np.minimum(text + 1, len(bounds) - 1)])
            starts, text = starts[inside], text[inside]
            h = grams_at(words, starts, length)
            place = np.minimum(np.searchsorted(windows, h), len(windows) - 1)
            real = windows[place] == h
            starts, text, place = starts[real], text[real], place[real]
            if not len(starts):
                continue
            # runs of one window at neighbouring places go together before they are told to its items
            new = np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (starts[1:] != starts[:-1] + 1)))
            begin = np.flatnonzero(new)
            stops = starts[np.append(begin[1:], len(starts)) - 1] + length
            starts, text, place = starts[begin], text[begin], place[begin]
            many = np.diff(cuts)[place]
            each = np.repeat(np.arange(len(place)), many)
            item = items[np.repeat(cuts[place] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))]
            order = np.lexsort((starts[each], item, text[each]))
            each, item = each[order], item[order]
            a, b, d = starts[each], stops[each], text[each]
            reach = np.maximum.accumulate(b + (d * len(self.ids) + item) * (len(words) + length + 1)) - (d * len(self.ids) + item) * (len(words) + length + 1)
            head = np.concatenate(([True], (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (a[1:] > reach[:-1])))
            at = np.flatnonzero(head)
            last = np.append(at[1:], len(a)) - 1
            for d_, i, p, q in zip(d[at].tolist(), item[at].tolist(), a[at].tolist(), reach[last].tolist(), strict=True):
                found.setdefault(d_, []).append((p - int(bounds[d_]), q - int(bounds[d_]), self.ids[i]))
        return found


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id string, words binary, n_words long) of the items that have any."""

    def run(batches):
        for batch in T.pieces_of(batches):
            words, bounds = T.word_hashes(batch.column("text"), T.ALNUM)
            cut = [words[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column("item_id"), pa.array(cut, pa.binary()), pa.array(np.diff(bounds), pa.int64())], ["item_id", "words", "n_words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    return rows.mapInArrow(run, "item_id string, words binary, n_words long").where("n_words > 0")


def index_of(benchmark: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> Index | None:
    """The index of a benchmark of at most block_words words; None for a larger one."""
    items = item_words(benchmark)
    if (items.agg(F.sum("n_words")).first()[0] or 0) > block_words:
        return None
    table = items.toArrow()
    return Index(table.column("item_id").to_pylist(), [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()], window, gram)


def judge(n_words: int, found: list[tuple[int, int, str]]) -> tuple:
    """(n_words, n_hit, n_items, items_sha256, contaminated) of a text from its runs."""
    n_hit, reach = 0, 0
    for start, stop, _ in sorted(found):
        n_hit += max(0, stop - max(start, reach))
        reach = max(reach, stop)
    items = sorted({x[2] for x in found})
    return n_words, n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0 and SHARE * n_hit >= n_words


_FOUND_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("item", pa.string())]))
_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]


def _judged(ids: pa.Array, counts: list[int], found: list[list[tuple[int, int, str]]]) -> pa.RecordBatch:
    columns = list(zip(*[judge(n, x) for n, x in zip(counts, found, strict=True)], strict=True)) or [[]] * len(_TYPES)
    spans = [[{"start": a, "stop": b, "item": c} for a, b, c in sorted(x)] for x in found]
    return pa.record_batch([ids, *(pa.array(list(x), t) for x, t in zip(columns, _TYPES, strict=True)), pa.array(spans, _FOUND_ARROW)], ["doc_id", *_NAMES, "spans"])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for each row of docs.

    spans: the maximal runs of a document's words that windows of an item cover (start, stop in words; item id).
    """
    index = index_of(benchmark, window, gram, block_words)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {RESULT}, spans {_FOUND}"
    if index is None:
        return _scan_joined(docs.select("doc_id", "text"), benchmark, window, gram, schema)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in T.pieces_of(batches):
            words, bounds = T.word_hashes(batch.column("text"), T.ALNUM)
            found = shared.value.scan(words, bounds)
            yield _judged(batch.column("doc_id"), np.diff(bounds).tolist(), [found.get(i, []) for i in range(batch.num_rows)])

    return T.bounded(docs).select("doc_id", "text").mapInArrow(run, schema)


def _scan_joined(docs: DataFrame, benchmark: DataFrame, window: int, gram: int, schema: str) -> DataFrame:
    """`scan` for a benchmark that no task can hold: a join of fingerprints, then each document with its items."""
    rows = save(T.bounded(docs).withColumn("row", F.monotonically_increasing_id()))
    items = save(item_words(benchmark).withColumn("item", F.monotonically_increasing_id()))
    lengths = sorted(min(window, r.n) for r in items.select(F.least("n_words", F.lit(window)).alias("n")).distinct().collect())

    def prints(key: np.ndarray, words: np.ndarray, bounds: np.ndarray, own: np.ndarray, length: int) -> pa.RecordBatch:
        at = fingerprints(words, length, gram)
        text = np.searchsorted(bounds, at, "right") - 1
        g = T.grams(words, min(gram, length))[at]
        pick = own[text]
        pairs = np.unique(np.stack((g[pick].view(np.int64), key[text[pick]])), axis=1) if pick.any() else np.zeros((2, 0), np.int64)
        return pa.record_batch([pa.array(np.full(pairs.shape[1], length), pa.int32()), pa.array(pairs[0]), pa.array(pairs[1])], ["length", "print", "key"])

    def of_docs(batches):
        for batch in T.pieces_of(batches):
            words, bounds = T.word_hashes(batch.column("text"), T.ALNUM)
            for n in lengths:
                yield prints(batch.column("row").to_numpy(zero_copy_only=False), words, bounds, np.ones(batch.num_rows, bool), n)

    def of_items(batches):
        for batch in batches:
            for key, words in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist(), strict=True):
                own = np.frombuffer(words, np.uint64)
                yield prints(np.array([key]), own, np.array([0, len(own)]), np.ones(1, bool), min(window, len(own)))

    shape = "length int, print long, key long"
    mine = rows.select("row", "text").mapInArrow(of_docs, shape).withColumnRenamed("key", "row")
    theirs = items.select("item", "words").mapInArrow(of_items, shape).withColumnRenamed("key", "item")
    met = mine.join(theirs, ["length", "print"]).select("row", "item").distinct()
    none = F.lit(None)
    heads = rows.select("row", F.lit(0).alias("kind"), "doc_id", "text", none.cast("string").alias("item_id"), none.cast("binary").alias("words"))
    tails = met.join(items, "item").select("row", F.lit(1).alias("kind"), none.cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), none.cast("string").alias("text"), "item_id", "words")
    dealt = heads.unionByName(tails).repartition("row").sortWithinPartitions("row", "kind")
    id_type = rows.select("doc_id").limit(0).toArrow().schema.field("doc_id").type

    def run(batches):
        held: tuple | None = None  # the document whose items are coming

        def done() -> pa.RecordBatch:
            doc_id, words, found = held
            return _judged(pa.array([doc_id], id_type), [len(words)], [found])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("kind", "doc_id", "text", "item_id", "words"))
            for kind, doc_id, text, item_id, item in zip(*columns, strict=True):
                if kind == 0:
                    if held is not None:
                        yield done()
                    held = (doc_id, T.word_hashes(pa.array([text], pa.string()), T.ALNUM)[0], [])
                else:
                    own = held[1]
                    held[2].extend(Index([item_id], [np.frombuffer(item, np.uint64)], window, gram).scan(own, np.array([0, len(own)])).get(0, []))
        if held is not None:
            yield done()

    return dealt.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    index = index_of(benchmark, window, gram, block_words)
    if index is None:
        row = next(name for i in range(len(docs.columns) + 1) if (name := f"__row{i}") not in docs.columns)
        rows = save(docs.withColumn(row, F.monotonically_increasing_id()))
        bad = scan(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, window, gram, block_words).where("contaminated").select(F.col("doc_id").alias(row))
        return rows.join(bad, row, "left_anti").select(*[rows[c] for c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in T.pieces_of(batches):
            words, bounds = T.word_hashes(batch.column(batch.schema.get_field_index("text")), T.ALNUM)
            keep = np.ones(batch.num_rows, bool)
            for i, spans in shared.value.scan(words, bounds).items():
                keep[i] = not judge(int(bounds[i + 1] - bounds[i]), spans)[4]
            yield batch.filter(pa.array(keep))

    return T.bounded(docs).mapInArrow(run, docs.schema)
