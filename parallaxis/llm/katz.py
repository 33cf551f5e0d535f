"""Katz backoff language model: trigrams backed off to bigrams and these to unigrams, with Good-Turing discounts.

P(w | h) = D(c(hw)) / c(h) for a bigram seen in training, else alpha(h) * P(w); P(w) = D(c(w)) / N for a known word, else
the mass that the discounts leave. D(r) is Good-Turing for r <= 5; a larger count gives up DELTA, so every context keeps
something for unseen words. alpha(h) is what the seen words leave, divided by what they leave of the unigrams: the
probabilities after each context sum to 1.

The model is a table partitioned by word: a part holds all bigrams that end in its words, with their counts and those
of the words, so no part needs another's unigrams. Counting and scoring meet there as packed arrays. A token's score is
a sum, so its parts are added wherever they are known: the bigram's or the word's own term in the word's part (with
- log c(word), which the next token owes as its context), the correction alpha(h) * c(h) of tokens that backed off in
the context's part. A frequent word is dealt by context over many parts; the counts of such words (at most HOT) are known
to all tasks.

Trigrams (order 3) are a table of their own, partitioned by context (u, v): those that training has `least` times or more (2, the usual cut-off; 1 keeps all).
P(w | u v) = D(c(uvw)) / c(uv) for these, else alpha(uv) * P(w | v), where P(w | v) is the bigram model's own probability,
so the recursion ends in the unigrams; a context without such trigrams has alpha 1, and a text's first word has the start
alone as its context. The text's score is the bigram model's and, for each token, what its trigram or alpha(uv) changes:
the table holds that change for each trigram (joined once with the table of bigrams), and only tokens with a context in
the table are dealt to it.

Bigrams name their context by 40 bits of its hash (5 million words: some 10 pairs of words share a context's row);
trigrams name both their bigrams by 48 (of 15 million bigrams less than one pair shares a name).

Results for odd input: a null text counts as empty, and an empty text is scored as its end; long texts are used whole;
equal texts score alike; repeated or null ids are scored row by row; without training rows all words are unknown; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import Scratch, save, tidy
from . import _text as T
from .ngram_join import _rows

U64 = np.uint64
END, START = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
K = 5
DELTA = 0.01
FLUSH = 1 << 19
PART = 1 << 20  # tokens of a part
HELD = 1 << 19  # rows whose sums a task holds
HOT = 1 << 15
CONTEXT = U64(24)  # bits of a context's hash that are dropped
ORDER = 3
LEAST = 2  # occurrences of a trigram that the table holds; 1 keeps all
SIEVE = 27  # bits of the number of bits of a filter of contexts: 16 MB


class Discounts:
    """D(r) of one order from the counts of counts."""

    def __init__(self, of_counts: np.ndarray):
        n = np.asarray(of_counts, float)  # n[r] for r = 0 .. K + 1
        self.d = np.arange(K + 1, dtype=float)
        common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        for r in range(1, K + 1):
            got = 0.0
            if n[r] and common < 1:
                got = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) * r
            self.d[r] = got if 0 < got < r else r - 0.5

    def __call__(self, r: np.ndarray) -> np.ndarray:
        return np.where(r <= K, self.d[np.minimum(r, K)], r - DELTA)

    def left(self, r: np.ndarray) -> np.ndarray:
        """What counts give up, r - D(r): never taken from a difference of large numbers."""
        return np.where(r <= K, (np.arange(K + 1) - self.d)[np.minimum(r, K)], DELTA)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words with one end for each text, their contexts, bounds)."""
    words, bounds = T.word_hashes(column, T.SPACED)
    return np.insert(words, bounds[1:], END), np.insert(words, bounds[:-1], START), bounds + np.arange(len(bounds))


def _pair(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The name of a bigram, from its word and the kept bits of its context: the upper 48 bits of a hash."""
    return T.mix(T.mix(word) + context * U64(0xA0761D6478BD642F)) & ~U64(0xFFFF)


def _six(names: np.ndarray) -> bytes:
    """Names in six bytes each."""
    return (names >> U64(16)).astype(np.uint32).tobytes() + (names >> U64(48)).astype(np.uint16).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, np.uint32, n).astype(np.uint64) << U64(16) | np.frombuffer(data, np.uint16, n, 4 * n).astype(np.uint64) << U64(48)


def _bigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the bigram before, its own bigram, bounds) of each token but a text's first."""
    tokens, contexts, bounds = _tokens(column)
    names = _pair(tokens, contexts >> CONTEXT)
    later = np.ones(len(tokens), bool)
    later[bounds[:-1]] = False
    own = np.flatnonzero(later)
    return names[own - 1], names[own], bounds - np.arange(len(bounds))


def _parts(word: np.ndarray, context: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """The part of each bigram: by its word, or by both if the word is hot."""
    key = T.mix(word)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, word), len(hot) - 1)
        key = np.where(hot[at] == word, T.mix(word ^ T.mix(context)), key)
    return (key >> U64(64 - bits)).astype(np.int32)


def _grouped(word: np.ndarray, context: np.ndarray, top: np.ndarray, wide: bool) -> np.ndarray:
    """An order by the upper 32 bits of top, with equal words together and so the equal contexts of a word. top: ends in
    bits of the word, and says all that stands before it.

    One sort of 32 + 32 bits; where these don't tell words or contexts apart, the words concerned are sorted by their values.
    """
    key = top & ~U64(0xFFFFFFFF) | context >> U64(32 if wide else 8)
    order = np.argsort(key)
    key, w, c = key[order], word[order], context[order]
    high = key >> U64(32)
    mixed = (high[1:] == high[:-1]) & (w[1:] != w[:-1]) | (key[1:] == key[:-1]) & (c[1:] != c[:-1])
    if mixed.any():
        at = np.flatnonzero(np.isin(high, high[1:][mixed]))
        order[at] = order[at][np.lexsort((c[at], w[at], high[at]))]
    return order


def _by_bucket(bucket: np.ndarray) -> np.ndarray:
    """A stable order by buckets; numbers of 16 bits are sorted by their digits."""
    return np.argsort(bucket.astype(np.uint16) if not len(bucket) or bucket.max() < 1 << 16 else bucket, kind="stable")


_SENT = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in ("words", "reps", "low", "high", "doc", "ids", "flags"))])


def _deal(docs: DataFrame, bits: int, hot: np.ndarray, train_only: bool, grams=_tokens, sieve: np.ndarray | None = None, more: DataFrame | None = None) -> DataFrame:
    """Packed bigrams of docs (row long, text, train boolean) by part. train_only: those of training rows, counted.

    grams: what makes (keys, seconds, bounds) of texts; seconds are kept whole if these aren't words and contexts. sieve:
    bits of the keys that are wanted. more: packed rows of other kinds that go to the same parts.
    """
    wide = grams is not _tokens
    shared = None if sieve is None else docs.sparkSession.sparkContext.broadcast(sieve)

    def send(batches):
        held, n, rows_n = [], 0, 0

        def flush() -> pa.RecordBatch:
            tokens, contexts, of, ids, flags = (np.concatenate(c) for c in zip(*held, strict=True))
            if train_only:
                kept = flags[of]
                tokens, contexts, of = tokens[kept], contexts[kept], of[kept]
            if shared is not None:
                at = (tokens >> U64(64 - SIEVE)).astype(np.int64)
                kept = (shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                tokens, contexts, of = tokens[kept], contexts[kept], of[kept]
            part = _parts(tokens, contexts, hot, bits)
            contexts = contexts if wide else contexts >> CONTEXT
            order = _grouped(tokens, contexts, part.astype(np.uint64) << U64(64 - bits) | tokens >> U64(bits), wide)
            part, tokens, contexts, of = part[order], tokens[order], contexts[order], of[order]
            if train_only:  # one entry for each bigram; its count stands for the document
                new = np.flatnonzero(np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (contexts[1:] != contexts[:-1])))) if len(tokens) else np.zeros(0, int)
                of = np.diff(np.concatenate((new, [len(tokens)]))).astype(np.uint32)
                part, tokens, contexts = part[new], tokens[new], contexts[new]
            where = (b"", b"") if train_only else (zlib.compress(np.diff(ids, prepend=0).tobytes(), 1), np.packbits(flags).tobytes())
            out = []
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) else []
            for a, b in itertools.pairwise(list(cuts)):
                w = tokens[a:b]
                first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                reps = np.diff(np.concatenate((first, [len(w)]))).astype(np.uint32)
                c = contexts[a:b]
                names = (_six(w[first]), reps.tobytes(), _six(c), b"") if wide else (w[first].tobytes(), reps.tobytes(), c.astype(np.uint32).tobytes(), (c >> U64(32)).astype(np.uint8).tobytes())
                out.append((int(part[a]), *names, of[a:b].astype(np.uint32 if train_only else np.uint16).tobytes(), *where))
            return _rows(_SENT, out) if out else None

        for batch in T.pieces_of(batches, limit=1 << 20):
            tokens, contexts, bounds = grams(batch.column("text"))
            for a in range(0, batch.num_rows, 30_000):
                b = min(a + 30_000, batch.num_rows)
                if held and (n >= FLUSH or rows_n + b - a > 60_000):
                    if (out := flush()) is not None:
                        yield out
                    held, n, rows_n = [], 0, 0
                own = slice(bounds[a], bounds[b])
                ids = batch.column("row").slice(a, b - a).to_numpy(zero_copy_only=False)
                flags = batch.column("train").slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                held.append((tokens[own], contexts[own], T.spread(bounds[a : b + 1]) + rows_n, ids, flags))
                n, rows_n = n + int(bounds[b] - bounds[a]), rows_n + b - a
        if held and (out := flush()) is not None:
            yield out

    packed = T.bounded(docs).select("row", "text", "train").mapInArrow(send, "bucket int, words binary, reps binary, low binary, high binary, doc binary, ids binary, flags binary")
    packed = packed if more is None else packed.unionByName(more)
    return packed.repartition("bucket").sortWithinPartitions("bucket")


class _Part:
    """The bigrams of one part, equal ones together and so are those of a word."""

    def __init__(self, rows: list[tuple], counted: bool, wide: bool = False):
        word, context, of, ids, flags, shift = [], [], [], [], [], 0
        for _, words, reps, low, high, doc, packed, bits in rows:
            word.append(np.repeat(_from_six(words) if wide else np.frombuffer(words, np.uint64), np.frombuffer(reps, np.uint32)))
            context.append(_from_six(low) if wide else np.frombuffer(low, np.uint32).astype(np.uint64) | (np.frombuffer(high, np.uint8).astype(np.uint64) << U64(32)))
            of.append(np.frombuffer(doc, np.uint32 if counted else np.uint16).astype(np.int64) + (0 if counted else shift))
            if not counted:
                own = np.cumsum(np.frombuffer(zlib.decompress(packed), np.int64))
                ids.append(own)
                flags.append(np.unpackbits(np.frombuffer(bits, np.uint8))[: len(own)])
                shift += len(own)
        word, context, of = np.concatenate(word), np.concatenate(context), np.concatenate(of)
        order = _grouped(word, context, word, wide)
        self.word, self.context, self.of = word[order], context[order], of[order]
        new_word = np.concatenate(([True], self.word[1:] != self.word[:-1]))
        new_pair = new_word | np.concatenate(([True], self.context[1:] != self.context[:-1]))
        self.pairs, self.words = np.flatnonzero(new_pair), np.flatnonzero(new_word)
        if counted:
            n = self.of
        else:
            self.ids, train = np.concatenate(ids), np.concatenate(flags).astype(np.int64)
            n = train[self.of]
        self.pair_counts, self.word_counts = np.add.reduceat(n, self.pairs), np.add.reduceat(n, self.words)
        self.pair_of, self.word_of = np.cumsum(new_pair) - 1, np.cumsum(new_word) - 1


def _parts_of(batches) -> Iterator[tuple[int, list[tuple]]]:
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for bucket, own in itertools.groupby(rows, key=lambda r: r[0]):
        yield bucket, list(own)


class Facts:
    """What all tasks know of the training rows: totals, discounts, and the counts of the most frequent words."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, tokens: int, kinds: int, texts: int, hot: np.ndarray, hot_counts: np.ndarray):
        self.tokens, self.kinds, self.texts = tokens, kinds, texts
        self.word, self.pair = Discounts(words), Discounts(pairs)
        self.hot, self.hot_counts = hot, hot_counts
        few = np.arange(K + 2) * (np.arange(K + 2) <= K)
        given = float(self.word.d @ words[: K + 1]) + (tokens - few @ words) - DELTA * (kinds - words[1 : K + 1].sum())
        self.unknown = max(1 - given / tokens, 1 / (tokens + 1)) if tokens else 1.0
        self.scale = (1 - self.unknown) / given if tokens else 0.0

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.word(counts) * self.scale, self.unknown)


def learn(docs: DataFrame, bits: int, scratch: Scratch, tables: bool = True, least: int = LEAST) -> tuple[Facts, DataFrame]:
    """One pass over the training rows: (counts of counts, totals, and words beyond a 2**-12 of all tokens; a table of
    kind 5, the bigrams (key, n, context) and kind 6, the words (context, n) that occur `least` times, if asked for)."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("context", pa.int64())])

    def count(batches):
        words, pairs, tokens, kinds = np.zeros(K + 2, np.int64), np.zeros(K + 2, np.int64), 0, 0
        frequent: list[tuple[int, int]] = []
        for _, rows in _parts_of(batches):
            p = _Part(rows, counted=True)
            words += np.bincount(p.word_counts[p.word_counts <= K + 1], minlength=K + 2)
            pairs += np.bincount(p.pair_counts[p.pair_counts <= K + 1], minlength=K + 2)
            tokens, kinds = tokens + int(p.word_counts.sum()), kinds + len(p.words)
            top = np.flatnonzero(p.word_counts >= p.word_counts.sum() >> 10)
            frequent += [(int(p.word[p.words[i]].view(np.int64)), int(p.word_counts[i])) for i in top[np.argsort(-p.word_counts[top], kind="stable")[:1024]]]
            if tables:
                two, one = np.flatnonzero(p.pair_counts >= least), np.flatnonzero(p.word_counts >= least)
                at = p.pairs[two]
                names, own = _pair(p.word[at], p.context[at]), p.word[p.words[one]] >> CONTEXT
                columns = [np.repeat([5, 6], [len(two), len(one)]).astype(np.int32), np.concatenate((names, own)).view(np.int64), np.concatenate((p.pair_counts[two], p.word_counts[one])), np.concatenate((p.context[at], own)).view(np.int64)]
                yield pa.record_batch([pa.array(c) for c in columns], schema=schema)
        out = [(0, r, int(n), 0) for r, n in enumerate(words)] + [(1, r, int(n), 0) for r, n in enumerate(pairs)] + [(2, 0, tokens, 0), (3, 0, kinds, 0)] + [(4, w, n, 0) for w, n in frequent]
        yield _rows(schema, out)

    dealt = _deal(docs, bits, np.zeros(0, np.uint64), True)
    counted = scratch.keep(dealt.mapInArrow(count, "kind int, key long, n long, context long"))
    sums = counted.where("kind < 5").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    found = sums.orderBy("kind", F.desc("n"), "key").limit(HOT).collect()
    of = lambda kind: {r.key: r.n for r in found if r.kind == kind}
    words, pairs = (np.array([of(k).get(r, 0) for r in range(K + 2)]) for k in (0, 1))
    tokens = of(2).get(0, 0)
    hot = {w: n for w, n in of(4).items() if n >= max(1, tokens >> (bits + 3))}
    keys = np.array(list(hot), np.int64).view(np.uint64)
    order = np.argsort(keys)
    texts = docs.where("train").count()
    return Facts(words, pairs, tokens, of(3).get(0, 0), texts, keys[order], np.array(list(hot.values()), np.int64)[order]), counted


# --- trigrams ---------------------------------------------------------------------------------------------------------


_SUMS = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("sums", pa.binary())])


def _discounted(d: Discounts, n: str):
    small = F.element_at(F.array(*[F.lit(float(x)) for x in d.d[1:]]), F.least(F.col(n), F.lit(K)).cast("int"))
    return F.when(F.col(n) <= K, small).otherwise(F.col(n) - F.lit(DELTA))


def _given_up(d: Discounts, n: str):
    """n - D(n), never taken from a difference of large numbers."""
    small = F.element_at(F.array(*[F.lit(float(r - x)) for r, x in enumerate(d.d)][1:]), F.least(F.col(n), F.lit(K)).cast("int"))
    return F.when(F.col(n) <= K, small).otherwise(F.lit(DELTA))


def trigrams(docs: DataFrame, bits: int, facts: Facts, counted: DataFrame, scratch: Scratch, least: int = LEAST) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(table (a, b, change): what each kept trigram, of bigrams a and b, changes of a token's score; contexts (a, change):
    what a context changes for other words; names of the most frequent contexts)."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def count(batches):
        of_counts = np.zeros(K + 2, np.int64)
        for _, rows in _parts_of(batches):
            p = _Part(rows, counted=True, wide=True)
            of_counts += np.bincount(p.pair_counts[p.pair_counts <= K + 1], minlength=K + 2)
            kept = np.flatnonzero(p.pair_counts >= least)
            at, top = p.pairs[kept], np.flatnonzero(p.word_counts >= PART >> 3)
            columns = [np.repeat([0, 2], [len(kept), len(top)]).astype(np.int32), np.concatenate((p.word[at], p.word[p.words[top]])).view(np.int64), np.concatenate((p.context[at].view(np.int64), np.zeros(len(top), np.int64))), np.concatenate((p.pair_counts[kept], p.word_counts[top]))]
            yield pa.record_batch([pa.array(c) for c in columns], schema=schema)
        yield _rows(schema, [(1, r, 0, int(n)) for r, n in enumerate(of_counts)])

    found = scratch.keep(_deal(docs, bits, np.zeros(0, np.uint64), True, _bigrams).mapInArrow(count, "kind int, a long, b long, n long"))
    of_counts = {r.a: r.n for r in found.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).collect()}
    discounts = Discounts(np.array([of_counts.get(r, 0) for r in range(K + 2)]))
    hot = [r.a for r in found.where("kind = 2").orderBy(F.desc("n"), "a").limit(HOT).collect()]
    bigrams = counted.where("kind = 5").select("key", F.col("n").alias("pair_n"), "context")
    words = counted.where("kind = 6").select("context", F.col("n").alias("word_n")).groupBy("context").agg(F.sum("word_n").alias("word_n"))
    own = bigrams.join(words, "context").select(F.col("key").alias("b"), "pair_n", "word_n")
    before = bigrams.select(F.col("key").alias("a"), F.col("pair_n").alias("context_n"))
    kept = found.where("kind = 0").select("a", "b", "n")
    # small numbers are stored, and what follows from them is computed when it is read
    stored = scratch.keep(kept.join(own, "b").join(before, "a").select("a", "b", "n", "pair_n", "word_n", "context_n"))
    scratch.drop(found, counted)
    rows = stored.withColumns({"p": F.least(F.lit(1.0), _discounted(facts.pair, "pair_n") / F.col("word_n")), "d": _discounted(discounts, "n")})
    table = rows.select("a", "b", (F.log10(F.col("d") / F.col("context_n")) - F.log10("p")).alias("change"))
    # c - sum of D(n) over some of the n that add up to c is what they leave of c, a whole number, and what they give up:
    # both are positive and exact, so neither remainder is the difference of two large sums
    left = lambda whole, n, given: (F.greatest(F.first(whole) - F.sum(n), F.lit(0)) + F.sum(given)) / F.first(whole)
    sums = rows.groupBy("a").agg(left("context_n", "n", _given_up(discounts, "n")).alias("own"), left("word_n", "pair_n", _given_up(facts.pair, "pair_n")).alias("below"))
    contexts = scratch.keep(sums.select("a", F.log10(F.col("own") / F.col("below")).alias("change")))
    return table, contexts, np.sort(np.array(hot, np.int64).view(np.uint64))


def changes(docs: DataFrame, bits: int, table: DataFrame, contexts: DataFrame, hot: np.ndarray) -> DataFrame:
    """(row, change): what the trigrams add to each row's score, once for each row that has any."""
    place = F.shiftrightunsigned("a", 64 - SIEVE) + 1
    parts = contexts.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    sieve = np.zeros(1 << (SIEVE - 3), np.uint8)
    for row in parts.collect():  # of a fixed size altogether; an iterator would outlive the shuffle that `tidy` deletes
        sieve[(row.b - 1) * 4096 : row.b * 4096] = np.frombuffer(row.m, np.uint8)
    spark = docs.sparkSession
    named = spark.createDataFrame([(int(x),) for x in hot.view(np.int64)], "a long")
    known = sorted((r.a, r.change) for r in contexts.join(F.broadcast(named), "a").collect())  # HOT at most
    shared = spark.sparkContext.broadcast((np.array([a for a, _ in known], np.int64).view(np.uint64), np.array([c for _, c in known], float), hot))

    def pack(batches):
        hot = shared.value[2]
        for batch in batches:
            a = batch.column("a").to_numpy().view(np.uint64)
            b = batch.column("b").to_numpy().view(np.uint64) if "b" in batch.schema.names else None
            part = _parts(a, a if b is None else b, np.zeros(0, np.uint64) if b is None else hot, bits)
            change, order = batch.column("change").to_numpy(), _by_bucket(part)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(part[order])) + 1, [len(order)])) if len(order) else []
            out = [(int(part[i[0]]), _six(a[i]), b"" if b is None else _six(b[i]), change[i].tobytes(), b"", b"", b"", b"") for i in (order[x:y] for x, y in itertools.pairwise(list(cuts)))]
            if out:
                yield _rows(_SENT, out)

    shape = "bucket int, words binary, reps binary, low binary, high binary, doc binary, ids binary, flags binary"
    more = table.mapInArrow(pack, shape).unionByName(contexts.mapInArrow(pack, shape))
    name = lambda a, b: T.mix(a + b * U64(0xD6E8FEB86659FD93))

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        ids, value = (np.concatenate(c) for c in zip(*held, strict=True))
        own, at = np.unique(ids, return_inverse=True)
        return own, np.bincount(at, value, len(own))

    def sent(ids: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        """Sums by the hash of their rows, packed."""
        bucket = (T.mix(ids.astype(np.uint64)) >> U64(64 - max(3, bits - 3))).astype(np.int32)
        order = _by_bucket(bucket)
        bucket, ids, value = bucket[order], ids[order], value[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        return _rows(_SUMS, [(int(bucket[a]), zlib.compress(ids[a:b].tobytes(), 1), value[a:b].tobytes()) for a, b in itertools.pairwise(cuts.tolist())])

    def total_of(batches):
        for _, rows in _parts_of(batches):
            ids, value = added([(np.frombuffer(zlib.decompress(r[1]), np.int64), np.frombuffer(r[2], float)) for r in rows])
            yield pa.record_batch([pa.array(ids), pa.array(value)], ["row", "change"])

    def run(batches):
        hot, hot_change, _ = shared.value
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        for _, rows in _parts_of(batches):
            own = [r for r in rows if r[5]]
            if not own:
                continue
            held = [r for r in rows if not r[5] and r[2]]
            p = _Part(own, counted=False, wide=True)
            joined = lambda rows, i: np.concatenate([np.zeros(0, np.uint64), *(_from_six(r[i]) for r in rows)])
            keys = name(joined(held, 1), joined(held, 2))
            value, order = np.frombuffer(b"".join(r[3] for r in held), float), np.argsort(keys)
            keys, value = keys[order], value[order]
            around = [r for r in rows if not r[5] and not r[2]]
            names, change = np.concatenate((joined(around, 1), hot)), np.concatenate((np.frombuffer(b"".join(r[3] for r in around), float), hot_change))
            order = np.argsort(names)
            names, change = names[order], change[order]
            a, want = p.word[p.pairs], name(p.word[p.pairs], p.context[p.pairs])
            term = np.zeros(len(want))
            if len(names):
                at = np.minimum(np.searchsorted(names, a), len(names) - 1)
                term = np.where(names[at] == a, change[at], 0.0)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                term = np.where(keys[at] == want, value[at], term)
            total, has = np.bincount(p.of, term[p.pair_of], len(p.ids)), np.bincount(p.of, minlength=len(p.ids)) > 0
            if has.any():
                sums = [added([*sums, (p.ids[has], total[has])])]
            if sums and len(sums[0][0]) >= HELD:
                yield sent(*sums.pop())
        if sums:
            yield sent(*sums[0])

    dealt = _deal(docs, bits, hot, False, _bigrams, sieve, more).mapInArrow(run, "bucket int, ids binary, sums binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(total_of, "row long, change double")


_MID = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((x, pa.binary()) for x in ("key", "a", "b", "c"))])


def score(docs: DataFrame, facts: Facts, bits: int) -> DataFrame:
    """(row, n_known, base, score): sums over the tokens of each row that has any in a part; to be added up by row."""
    shared = docs.sparkSession.sparkContext.broadcast(facts)

    def spread(kind: int, key: np.ndarray, *values: np.ndarray) -> list[tuple]:
        bucket = (T.mix(key.astype(np.uint64)) >> U64(64 - max(3, bits - 3))).astype(np.int32)  # these rows are fewer
        order = _by_bucket(bucket)
        bucket, key, values = bucket[order], key[order], [v[order] for v in values]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else []
        return [(int(bucket[a]), kind, zlib.compress(key[a:b].tobytes(), 1) if kind == 2 else key[a:b].tobytes(), *(v[a:b].tobytes() for v in values), *[b""] * (3 - len(values))) for a, b in itertools.pairwise(list(cuts))]

    def words(batches):
        f = shared.value
        held: list[tuple[np.ndarray, ...]] = []

        def added() -> tuple[np.ndarray, ...]:
            """The held rows' sums, each row once."""
            ids, *values = (np.concatenate(c) for c in zip(*held, strict=True))
            own, at = np.unique(ids, return_inverse=True)
            known, based, scored = (np.bincount(at, v, len(own)) for v in values)
            return own, known.astype(np.uint32), based, scored

        for _, rows in _parts_of(batches):
            p = _Part(rows, counted=False)
            c2 = p.word_counts
            if len(f.hot):
                own = p.word[p.words]
                at = np.minimum(np.searchsorted(f.hot, own), len(f.hot) - 1)
                c2 = np.where(f.hot[at] == own, f.hot_counts[at], c2)
            ends = p.word[p.words] == END
            p1 = f.unigram(c2)
            seen = p.pair_counts > 0
            d12 = np.where(seen, f.pair(p.pair_counts), 0.0)
            pair_word = p.word_of[p.pairs]
            term = np.where(seen, np.log10(np.where(seen, d12, 1.0)), np.log10(p1[pair_word]))
            owed = np.where((c2 > 0) & ~ends, -np.log10(np.maximum(c2, 1)), 0.0)
            base = np.log10(c2 + 0.1)
            rows_n = len(p.ids)
            known = np.bincount(p.of, (c2 > 0)[p.word_of].astype(float), rows_n).astype(np.uint32)
            based = np.bincount(p.of, base[p.word_of], rows_n)
            scored = np.bincount(p.of, term[p.pair_of] + owed[p.word_of], rows_n)
            has = np.bincount(p.of, minlength=rows_n) > 0
            held.append((p.ids[has], known[has], based[has], scored[has]))
            if len(held) > 1:
                held[:] = [added()]
            out = []
            if len(held[0][0]) >= HELD:
                out = spread(2, *held.pop())
            # contexts: what the counts of the words seen after them give up, and these words' unigram mass
            at = np.flatnonzero(seen)
            context = p.context[p.pairs[at]]
            order = np.argsort(context)
            at, context = at[order], context[order]
            if len(at):
                first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
                sums = [np.add.reduceat(x, first) for x in (f.pair.left(p.pair_counts[at]), p1[pair_word[at]])]
                out += spread(0, context[first], *(x.astype(np.float64) for x in sums))
            late = np.flatnonzero(~seen[p.pair_of])
            out += spread(1, p.context[late], p.ids[p.of[late]])
            if out:
                yield _rows(_MID, out)
        if held:
            yield _rows(_MID, spread(2, *added()))

    def contexts(batches):
        f = shared.value
        for _, rows in _parts_of(batches):
            known = [r for r in rows if r[1] == 0]
            late = [r for r in rows if r[1] == 1]
            done = [r for r in rows if r[1] == 2]
            ids, known_n, base, scored = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)], [np.zeros(0)]
            if known and late:
                key = np.frombuffer(b"".join(r[2] for r in known), np.uint64)
                order = np.argsort(key)
                key = key[order]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                left, p1 = (np.add.reduceat(np.frombuffer(b"".join(r[i] for r in known), np.float64)[order], first) for i in (3, 4))
                left = left / np.maximum(1 - p1, f.unknown)
                key, fix = key[first], np.log10(left)  # alpha(h) * c(h)
                want = np.frombuffer(b"".join(r[2] for r in late), np.uint64)
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                fixed = np.where(key[at] == want, fix[at], 0.0)
                ids.append(np.frombuffer(b"".join(r[3] for r in late), np.int64))
                known_n.append(np.zeros(len(fixed)))
                base.append(np.zeros(len(fixed)))
                # the debt - log c(h) was taken with the context's own word; c(h) is in `left`, so alpha remains
                scored.append(fixed)
            for r in done:
                own = np.frombuffer(zlib.decompress(r[2]), np.int64)
                ids.append(own)
                for to, i, t in ((known_n, 3, np.uint32), (base, 4, np.float64), (scored, 5, np.float64)):
                    to.append(np.frombuffer(r[i], t).astype(float))
            ids, columns = np.concatenate(ids), [np.concatenate(x) for x in (known_n, base, scored)]
            if len(ids):
                own, at = np.unique(ids, return_inverse=True)
                known_n, base, scored = (np.bincount(at, x, len(own)) for x in columns)
                yield pa.record_batch([pa.array(own), pa.array(known_n.astype(np.int64)), pa.array(base), pa.array(scored)], ["row", "n_known", "base", "score"])

    mid = _deal(docs, bits, facts.hot, False).mapInArrow(words, "bucket int, kind int, key binary, a binary, b binary, c binary")
    return mid.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(contexts, "row long, n_known long, base double, score double")


def held_out(parts: int = 10):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == 0


def evaluate(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; order: 2 or 3; least:
    how often training has the trigrams that the table holds (1: all of them)."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    rows = docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    odd = rows.where("doc_id is null").limit(1).count() or rows.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if odd or dict(rows.dtypes)["doc_id"] != "bigint":  # rows need names of their own
        rows = save(rows.withColumn("row", F.monotonically_increasing_id()))
    else:
        rows = rows.withColumn("row", F.col("doc_id"))
    text = F.coalesce("text", F.lit(""))
    sizes = rows.select("row", "doc_id", "held_out", (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long").alias("n_tokens"))
    given = rows.select("row", "text", (~F.col("held_out")).alias("train"))
    total = int(rows.select(F.sum(F.octet_length(text))).first()[0] or 0) // 6
    bits = max(3, (total // PART).bit_length())
    scratch, extra = Scratch(docs.sparkSession), None
    try:
        with tidy(docs.sparkSession):
            facts, counted = learn(given, bits, scratch, order > 2, least)
            if order > 2:
                table, contexts, hot = trigrams(given, bits, facts, counted, scratch, least)
                extra = save(changes(given, bits, table, contexts, hot).withColumnRenamed("change", "score"))
    finally:
        scratch.clear()
    parts = score(given, facts, bits)
    if extra is not None:
        parts = parts.unionByName(extra.select("row", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), "score"))
    sums = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_known", "base", "score")])
    scale = float(np.log10(facts.tokens + 0.1 * (facts.kinds + 1)))
    first = -float(np.log10(facts.texts)) if facts.texts else 0.0  # the first token's context is the start
    return sizes.join(sums, "row").select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(facts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("score") + first).alias("score"),
    )
