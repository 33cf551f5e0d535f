"""Phrase collocations from count streams in prefix and suffix order.

Texts are lower-cased (A-Z), split into pieces and these into words. What may be frequent is found order by order: a pass
over the texts names the phrases of n words whose first and last n - 1 words may both be frequent by 48 bits of a hash
and deals the names, packed, to parts that add them up; names that occur often enough set a filter of fixed size (16 MB
of bits), which the next order asks. One more pass counts the phrases of all orders that pass these filters by their words:
tasks count distinct phrases of a few megabytes of text, which are dealt, packed, and added up by their words. A wrong
yes costs an entry in this count and nothing else, as it decides; rare phrases, nearly all there are, never get that far.

What is frequent is laid out as two streams: in prefix order (by first word, second word, ...; a phrase stands right
before its extensions) and in suffix order (the same, words read backwards). One scan of a stream in lockstep of all its
orders knows the counts of the first 1, 2 and 3 words of each phrase, which are the rows passed last, and the largest
count of a right (left) extension, which is among the rows that follow. The two scans meet in a merge join. A phrase
inside one that is longer by several words lies inside one that is longer by one and as frequent, so these suffice.

A stream is dealt by its first two words. Counts of single words are joined to pairs, where a word that starts a large
part of all pairs is split by the join. Ranks within a language are limited before rows are moved.

Results for odd input: a null text is empty, a null language is `und`; texts without words give nothing; long texts are
used whole; each row counts, repeated or not; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import Scratch, save, tidy
from . import _text as T
from .katz import _from_six, _six
from .ngram_join import _by_bucket, _rows

U64 = np.uint64
LEAST = 30
LONGEST = 4
TOP = 2000
SIEVE = 27  # bits of the number of bits of the filter
PART = 1 << 22  # bytes of text whose names of phrases are added up at once
FLUSH = 1 << 20  # names that a task holds before it deals them
HELD = 1 << 19  # distinct phrases that a task holds

#: `[.,;:!?\x0A-\x0D]`: 1 for bytes between pieces
BREAK = bytes(b in b".,;:!?\n\v\f\r" for b in range(256))
#: 1 for bytes of words
WORD = bytes(not (BREAK[b] or b in b" \t") for b in range(256))


def _salts(names: list[str], known: dict[str, np.uint64]) -> np.ndarray:
    for x in set(names) - known.keys():
        known[x] = U64(int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little"))
    return np.array([known[x] for x in names], np.uint64)


def _passes(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> U64(64 - SIEVE)
    return (sieve[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool)


def _cut(batches) -> Iterator[tuple]:
    """Pieces of batches: (language of each text, lower-cased bytes, starts, ends, bounds, text, hash and run of each word);
    words of one run stand in one piece of one text."""
    salts: dict[str, np.uint64] = {}
    for batch in T.pieces_of(batches):
        names = batch.column("lang").to_pylist()
        data, offsets = T.column_bytes(batch.column("text"))
        data = T.translate(data, T.LOWER)
        starts, ends, bounds = T.cut_words(data, offsets, WORD)
        if not len(starts):
            continue
        text = T.spread(bounds)
        piece = np.searchsorted(np.flatnonzero(T.translate(data, BREAK)), starts)
        words = T.mix(T.hash_spans(data, starts, ends) ^ _salts(names, salts)[text])
        apart = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
        yield names, data, starts, ends, bounds, text, words, np.concatenate(([0], np.cumsum(apart)))


def _hashes(words: np.ndarray, run: np.ndarray, n: int, sieve: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the phrases of n words whose parts of n - 1 words pass the filter."""
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    wanted = run[: len(run) - n + 1] == run[n - 1 :]
    if sieve is not None:
        ok = _passes(sieve, T.grams(words, n - 1))
        wanted &= ok[:-1] & ok[1:]
    at = np.flatnonzero(wanted)
    return at, T.grams(words, n)[at]


def likely(docs: DataFrame, n: int, least: int, bits: int, sieve=None) -> np.ndarray:
    """A filter of all phrases of n words that occur `least` times: 2**SIEVE bits, whatever their number. sieve: a
    broadcast filter of those of n - 1 words. Names of six bytes are dealt to 2**bits parts and added up there."""
    schema = pa.schema([("bucket", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])

    def send(batches):
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            names, counts = np.unique(np.concatenate(held), return_counts=True)
            bucket, once, counts = (names >> U64(64 - bits)).astype(np.int32), counts == 1, counts.astype(np.uint32)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(names)]
            parts = [(int(bucket[a]), names[a:b], once[a:b], counts[a:b]) for a, b in itertools.pairwise(cuts)]
            return _rows(schema, [(k, _six(x[o]), _six(x[~o]), c[~o].tobytes()) for k, x, o, c in parts])

        for *_, words, run in _cut(batches):
            _, h = _hashes(words, run, n, None if sieve is None else sieve.value)
            if len(h):
                held.append(h)
            if sum(map(len, held)) >= FLUSH:
                yield flush()
                held.clear()
        if held:
            yield flush()

    def add_up(batches):
        for _, (once, more, counts) in _by_bucket(batches):
            names = np.concatenate([_from_six(x) for x in (*once, *more)])
            more_n = np.frombuffer(b"".join(counts), np.uint32).astype(np.int64)
            n_of = np.concatenate((np.ones(len(names) - len(more_n), np.int64), more_n))
            order = np.argsort(names)
            names = names[order]
            first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
            kept = names[first[np.add.reduceat(n_of[order], first) >= least]]
            yield pa.record_batch([pa.array((kept >> U64(64 - SIEVE)).astype(np.int64) + 1)], ["place"])

    dealt = T.bounded(docs).mapInArrow(send, "bucket int, once binary, more binary, counts binary").repartition("bucket").sortWithinPartitions("bucket")
    places = dealt.mapInArrow(add_up, "place long")
    parts = places.groupBy(F.bitmap_bucket_number("place").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("m"))
    out = np.zeros(1 << (SIEVE - 3), np.uint8)
    for row in parts.collect():  # 4096 rows at most; an iterator would outlive the shuffle, which goes as the action ends
        out[(row.b - 1) * 4096 : row.b * 4096] = np.frombuffer(row.m, np.uint8)
    return out


def count_phrases(docs: DataFrame, longest: int, least: int, bits: int, sieve) -> DataFrame:
    """(lang, phrase, n, f): phrases of 1 to `longest` words that occur `least` times, of those that pass a broadcast filter;
    also all words of each language, as an empty phrase with n = 0. Phrases are dealt to 2**bits parts, packed by language
    with line ends between them (no word has any), and added up there by their words."""
    schema = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary())])

    def send(batches):
        totals: dict[str, int] = {}
        held: list[tuple] = []

        def merged() -> tuple:
            h, counts = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            own, first, of = np.unique(h, return_index=True, return_inverse=True)
            langs, phrases = (pa.chunked_array([x[i] for x in held]).take(pa.array(first)).combine_chunks() for i in (2, 3))
            return own, np.bincount(of, counts, len(own)).astype(np.int64), langs, phrases

        def packed(x: tuple) -> pa.RecordBatch:
            langs = x[2].dictionary_encode()
            bucket, code = (x[0] >> U64(64 - bits)).astype(np.int32), langs.indices.to_numpy()
            order = np.lexsort((code, bucket))
            bucket, code, counts = bucket[order], code[order], x[1][order]
            cuts = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), len(order)]
            listed = pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), x[3].take(pa.array(order)).cast(pa.large_binary()))
            columns = [pa.array(bucket[cuts[:-1]]), langs.dictionary.take(pa.array(code[cuts[:-1]])), pc.binary_join(listed, pa.scalar(b"\n", pa.large_binary())).cast(pa.binary())]
            return pa.record_batch([*columns, pa.array([counts[a:b].tobytes() for a, b in itertools.pairwise(cuts)], pa.binary())], schema=schema)

        for names, data, starts, ends, bounds, text, words, run in _cut(batches):
            for x, k in zip(names, np.diff(bounds).tolist(), strict=True):
                totals[x] = totals.get(x, 0) + k
            inside = T.translate(data, WORD).view(bool)
            ends_at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
            every = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends_at), pa.py_buffer(data[inside]))
            langs = pa.array(names, pa.string())
            for n in range(1, longest + 1):
                at, h = _hashes(words, run, n, None)
                ok = _passes(sieve.value, h)
                h, first, counts = np.unique(h[ok], return_index=True, return_counts=True)
                if not len(h):
                    continue
                at = at[ok][first]
                words_at = [every.take(pa.array(at + i)) for i in range(n)]
                phrases = words_at[0] if n == 1 else pc.binary_join_element_wise(*words_at, pa.scalar(" ", pa.large_string()))
                held.append((h, counts, langs.take(pa.array(text[at])), phrases))
            if sum(len(x[0]) for x in held) >= HELD:
                held = [merged()]
                if len(held[0][0]) >= HELD // 2:
                    yield packed(held.pop())
        if held:
            yield packed(merged())
        if totals:
            yield _rows(schema, [(0, x, b"", np.int64(k).tobytes()) for x, k in totals.items()])

    def add_up(batches):
        for _, (langs, phrases, counts) in _by_bucket(batches):
            split = pc.split_pattern(pa.array(phrases, pa.large_binary()), b"\n")
            of = np.repeat(np.arange(len(langs)), split.value_lengths().to_numpy())
            table = pa.table({"lang": pa.array(langs, pa.string()).take(pa.array(of)), "phrase": split.flatten(), "f": pa.array(np.frombuffer(b"".join(counts), np.int64))})
            sums = table.group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum")])
            n = np.where(pc.equal(sums["phrase"], b"").to_numpy(), 0, pc.count_substring(sums["phrase"], b" ").to_numpy() + 1).astype(np.int32)
            kept = pa.table({"lang": sums["lang"], "phrase": sums["phrase"], "n": pa.array(n), "f": sums["f_sum"]}).filter(pa.array((sums["f_sum"].to_numpy() >= least) | (n == 0)))
            for batch in kept.combine_chunks().to_batches():
                yield pa.record_batch([batch["lang"], batch["phrase"].cast(pa.binary()).view(pa.string()), batch["n"], batch["f"]], ["lang", "phrase", "n", "f"])

    dealt = T.bounded(docs).mapInArrow(send, "bucket int, lang string, phrases binary, counts binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(add_up, "lang string, phrase string, n int, f long")


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n, f) of phrases of n words that occur `least` times, (lang, n) of all words)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(10, (size // PART).bit_length())
    share = docs.sparkSession.sparkContext.broadcast
    passed, sieve = np.zeros(1 << (SIEVE - 3), np.uint8), None
    for n in range(1, longest + 1):
        own = likely(rows, n, least, bits, sieve)
        passed |= own  # hashes of phrases of different lengths have nothing in common
        if sieve is not None:
            sieve.unpersist()
        sieve = share(own if n < longest else passed)
    kept = scratch.keep(count_phrases(rows, longest, least, bits, sieve))
    sieve.unpersist()
    return kept.where("n > 0"), kept.where("n = 0").select("lang", F.col("f").alias("n"))


def _scan(stream: DataFrame, words: DataFrame, longest: int, start: str, extended: str) -> DataFrame:
    """(lang, phrase, n, f, start1 .. , extended): a stream (lang, phrase, f, n, w) in the order of its words w."""
    w = [f"__w{i}" for i in range(1, longest + 1)]
    split = stream.select("lang", "phrase", "f", "n", *[F.get("w", F.lit(i)).alias(c) for i, c in enumerate(w)])
    heads = split.where("n = 2").join(words.select("lang", F.col("phrase").alias(w[0]), F.col("f").alias("__head")), ["lang", w[0]])
    rows = heads.unionByName(split.where("n > 2").withColumn("__head", F.lit(None).cast("long")))
    order = [F.col(c).asc_nulls_first() for c in w[2:]]
    passed = Window.partitionBy("lang", *w[:2]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    columns = {f"{start}1": F.last("__head", True).over(passed)}
    for k in range(2, longest):
        columns[f"{start}{k}"] = F.last(F.when(F.col("n") == k, F.col("f")), True).over(passed)
    longer = F.lit(None).cast("long")
    for k in range(2, longest):
        block = Window.partitionBy("lang", *w[:k])
        longer = F.when(F.col("n") == k, F.max(F.when(F.col("n") == k + 1, F.col("f"))).over(block)).otherwise(longer)
    columns[extended] = F.coalesce(longer, F.lit(0))
    return rows.withColumns(columns).drop(*w, "__head")


def _score(a: str, l: str, r: str) -> Column:
    return F.expr(f"(2000000BD * cast({a} as decimal(20,0))) div (cast({l} as decimal(20,0)) + cast({r} as decimal(20,0)))")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to `longest` words of each language."""
    scratch = Scratch(docs.sparkSession)
    try:
        with tidy(docs.sparkSession):
            phrases, totals = frequent_phrases(docs, scratch, least, longest)
            one, rows, words = phrases.where("n = 1").drop("n"), phrases.where("n > 1"), F.split("phrase", " ")
            prefix = scratch.keep(_scan(rows.withColumn("w", words), one, longest, "l", "right"))
            suffix = scratch.keep(_scan(rows.withColumn("w", F.reverse(words)), one, longest, "r", "left").drop("n", "f"))
            both = prefix.join(suffix.hint("merge"), ["lang", "phrase"])
            kept = both.where(F.expr("100BD * cast(greatest(left, right) as decimal(20,0)) < 80BD * cast(f as decimal(20,0))"))
            cuts = [
                F.when(F.col("n") == n, F.array_min(F.array(*[F.struct(_score("f", f"l{k}", f"r{n - k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{n - k}").alias("r")) for k in range(1, n)])))
                for n in range(2, longest + 1)
            ]
            scored = kept.withColumn("cut", F.coalesce(*cuts)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
            place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
            best = scored.withColumn("rank", place).where(F.col("rank") <= top)
            return save(best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    finally:
        scratch.clear()
