"""Multilingual mixture inference for language ID.

Training counts byte n-grams of words (with word borders) for each language over all labelled rows. A document is a
mixture: each of its words was drawn from one language, with the likelihood of the word's n-grams under that language's
smoothed model. Expectation-maximisation estimates the document's proportions of all languages; then the languages
are added one by one in the order of their proportions, EM is run again on each set, and the set with the best
penalised log likelihood (a Bayesian penalty for each proportion) is the document's. The prediction is its main
language and the score its proportion.

Results for odd input: a null text or one without a letter is `und` with score 0; texts of any length are used whole;
labels that are null don't teach; without any labelled row everything is `und`; more than LANGUAGES labels are an error;
equal texts get equal results; extra columns are ignored by `predict` and kept by `clean`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

GRAM = 4
BITS = 17  # cells of an n-gram table: a fixed size for each language
SMOOTH = 0.1
ROUNDS = 50  # of EM at most
TOLERANCE = 1e-3  # EM ends when all proportions move by less
LANGUAGES = 256  # more labels than that are an error: all tasks hold a table of a fixed size for each
PENALTY = 4.0  # times half the logarithm of the number of words, for each language beyond the first
UNKNOWN = "und"
REJECT = 0.5  # `clean` drops documents whose main language has a smaller share

U64 = np.uint64
#: letters and bytes above ASCII stay, in lower case; all else borders a word
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_INSIDE = bytes(b != 0x20 for b in range(256))


def word_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, word bounds in cells, text bounds in words): the n-grams of each word with its borders."""
    data, offsets = T.column_bytes(column)
    data = T.translate(data, _LETTERS)
    starts, ends, bounds = T.cut_words(data, offsets, _INSIDE)
    # each word between two spaces, in one buffer: n-grams that reach over its end are left out
    sizes = ends - starts + 2
    at = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.full(int(at[-1]) + GRAM, 0x20, np.uint8)
    inside = np.ones(int(at[-1]), bool)
    inside[at[:-1]] = False
    inside[at[1:] - 1] = False
    flat[: int(at[-1])][inside] = data[T.translate(data, _INSIDE).view(bool)]
    code = np.zeros(int(at[-1]), np.uint32)
    for j in range(GRAM):
        code = (code << np.uint32(8)) | flat[j : j + len(code)]
    cells = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
    counts = np.maximum(sizes - GRAM + 1, 1)  # a word of one letter has one: border, letter, border and one more
    keep = np.zeros(len(cells) + 1, np.int8)
    np.add.at(keep, at[:-1], 1)
    np.add.at(keep, at[:-1] + counts, -1)
    return cells[np.cumsum(keep[:-1]) > 0], np.concatenate(([0], np.cumsum(counts))), bounds


class Model:
    """Log likelihood of each n-gram cell under each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts.sum(1, keepdims=True) + SMOOTH * counts.shape[1]
        self.log = np.log((counts + SMOOTH) / total).astype(np.float32)

    def words(self, cells: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(words, languages): the log likelihood of each word."""
        out = np.empty((len(bounds) - 1, len(self.languages)), np.float32)
        for i, row in enumerate(self.log):
            out[:, i] = np.add.reduceat(row[cells], bounds[:-1]) if len(cells) else 0
        return out


def _mixture(like: np.ndarray, base: np.ndarray, text: np.ndarray, starts: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM: (proportions of each text, its log likelihood). like: likelihoods relative to exp(base); starts: first words.

    Each text stops by itself when none of its proportions moves by TOLERANCE any more, so what stands beside it in a
    batch doesn't matter.
    """
    shares = shares.copy()
    live, of, begin, own = np.arange(len(starts)), text, starts, like
    for _ in range(ROUNDS):
        n = np.diff(np.append(begin, len(of)))[:, None]
        part = own * shares[live][of]
        part /= part.sum(1, keepdims=True)
        after = np.add.reduceat(part, begin, axis=0) / n
        moving = np.abs(after - shares[live]).max(1) >= TOLERANCE
        shares[live] = after
        if not moving.any():
            break
        if not moving.all():
            keep = moving[of]
            own, of = own[keep], (np.cumsum(moving) - 1)[of[keep]]
            live = live[moving]
            begin = np.searchsorted(of, np.arange(len(live)))
    whole = np.log((like * shares[text]).sum(1)) + base
    return shares, np.add.reduceat(whole.astype(np.float64), starts)


def infer(log: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, whether chosen) of each language in each text that has words."""
    starts, text = bounds[:-1], T.spread(bounds)
    n = np.diff(bounds)
    count = log.shape[1]
    base = log.max(1)
    like = np.maximum(np.exp(log - base[:, None]), 1e-30).astype(np.float32)
    shares, _ = _mixture(like, base, text, starts, np.full((len(starts), count), 1 / count, np.float32))
    order = np.argsort(-shares, axis=1, kind="stable")
    alone = np.add.reduceat(log.astype(np.float64), starts, axis=0)
    first = alone.argmax(1)
    # the best single language leads, the others follow by their proportions
    order = np.concatenate((first[:, None], np.array([[x for x in o if x != f] for o, f in zip(order.tolist(), first.tolist(), strict=True)], np.int64).reshape(len(starts), count - 1)), axis=1)
    chosen = np.zeros_like(shares, bool)
    chosen[np.arange(len(starts)), first] = True
    best = chosen.astype(np.float32)
    score = alone[np.arange(len(starts)), first]
    active = np.arange(len(starts))
    trial = chosen.copy()
    for k in range(1, count):
        # a language with less than half a word's share cannot pay its penalty
        active = active[shares[active, order[active, k]] * n[active] >= 0.5]
        if not len(active):
            break
        trial[active, order[active, k]] = True
        pick = np.isin(text, active)
        own = text[pick]
        where = np.searchsorted(active, own)
        begin = np.searchsorted(own, active)
        mask = trial[active].astype(np.float32)
        got, value = _mixture(like[pick] * mask[where] + np.float32(1e-35), base[pick], where, begin, mask / mask.sum(1, keepdims=True))
        value -= PENALTY * 0.5 * k * np.log(np.maximum(n[active], 2))
        better = value > score[active]
        rows = active[better]
        score[rows], best[rows], chosen[rows] = value[better], got[better], trial[rows]
    return best, chosen


def train(rows: DataFrame) -> Model:
    """Counts n-grams of all rows (text, lang); only one table of a fixed size for each language comes to the driver."""
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in T.pieces_of(batches):
            cells, words, bounds = word_grams(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            of_cell = np.repeat(np.repeat(code, np.diff(bounds)), np.diff(words))
            for i, name in enumerate(names):
                own = np.bincount(cells[of_cell == i], minlength=1 << BITS)
                sums[name] = sums[name] + own if name in sums else own
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "cell", "n"])

    known = T.bounded(rows).where("text is not null and lang is not null").select("text", "lang")
    if known.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    cells = known.mapInArrow(count, "lang string, cell int, n long")
    total = cells.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(total.column("lang").to_pylist()))
    counts = np.zeros((len(languages), 1 << BITS))
    if languages:
        code = np.searchsorted(np.array(languages), total.column("lang").to_numpy(zero_copy_only=False).astype(str))
        counts[code, total.column("cell").to_numpy()] = total.column("n").to_numpy()
    return Model(languages, counts)


def _judge(model: Model, column: pa.Array) -> tuple[list[str], list[float], list[list[tuple[str, float]]]]:
    cells, words, bounds = word_grams(column)
    n = len(column)
    names, scores, mixes = [UNKNOWN] * n, [0.0] * n, [[] for _ in range(n)]
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled) and model.languages:
        own = np.concatenate((bounds[filled], [bounds[-1]]))
        shares, chosen = infer(model.words(cells, words), own)
        for i, p, c in zip(filled.tolist(), shares, chosen, strict=True):
            at = int(np.where(c, p, -1).argmax())
            names[i], scores[i] = model.languages[at], min(1.0, max(0.0, float(p[at])))
            mixes[i] = [(model.languages[j], float(p[j])) for j in np.argsort(-p, kind="stable") if c[j]]
        # words of ASCII letters are letters for sure; others are looked at one by one
        data, offsets = T.column_bytes(column)
        ascii_letter = np.concatenate(([0], np.cumsum(T.translate(data, bytes(0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256))))))
        for i in filled[ascii_letter[offsets[filled + 1]] == ascii_letter[offsets[filled]]].tolist():
            if not any(c.isalpha() for c in column[i].as_py()):
                names[i], scores[i], mixes[i] = UNKNOWN, 0.0, []
    return names, scores, mixes


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, mixture array<struct<lang,share>>) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages times a fixed table

    def run(batches):
        for batch in T.pieces_of(batches):
            names, scores, mixes = _judge(shared.value, batch.column("text"))
            mixed = [[{"lang": a, "share": b} for a, b in x] for x in mixes]
            yield pa.record_batch([batch.column("doc_id"), pa.array(names), pa.array(scores, pa.float64()), pa.array(mixed, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], ["doc_id", "lang_pred", "score", "mixture"])

    return T.bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def remainder(parts: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def clean(docs: DataFrame, model: Model, least: float = REJECT) -> DataFrame:
    """The rows of docs whose language is known and has at least that share of the text, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in T.pieces_of(batches):
            names, scores, _ = _judge(shared.value, batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return T.bounded(docs).mapInArrow(run, docs.schema)
