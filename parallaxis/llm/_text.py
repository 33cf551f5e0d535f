"""Byte-level, vectorised text primitives shared by the operators of this subpackage.

Texts arrive as Arrow string columns. UTF-8 bytes below 0x80 are always whole ASCII characters, so every
word class used here (which is defined by ASCII bytes only) can be cut on bytes without decoding.
Work is done in windows of bounded size, whatever the length of one text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
WINDOW = (1 << 20) - 64  # bytes hashed at once; the power tables are no larger than the next power of two
BATCH = 1 << 21
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)

LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))

#: `[^\x20\x09-\x0D]+`: 1 for bytes of words
SPACED = bytes(not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256))

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing
ALNUM = bytes(0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256))

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, U64(_P)), np.full(size, U64(_P_INV))
        up[0] = down[0] = U64(1)
        _powers.clear()
        _powers[size] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _powers[size]


def bounded(docs: DataFrame) -> DataFrame:
    """docs, in a session that hands texts to Python in batches of BATCH bytes at most (or one row): batches of so many
    rows grow with the texts, and their buffers stay with the executor."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = docs.sparkSession.conf.get(name, None)
    if not (now or "").isdigit() or not 0 < int(now) <= BATCH:
        docs.sparkSession.conf.set(name, str(BATCH))
    return docs


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: all bits of the result depend on all bits of the argument."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def release() -> None:
    """Gives free memory back to the system: a worker waits for its next task without what this one took, and arrays of
    some MB stay with the process otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def pieces_of(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def translate(data: np.ndarray, table: bytes) -> np.ndarray:
    """table[b] for each byte b; a lookup that needs no index array."""
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


def cut_words(data: np.ndarray, offsets: np.ndarray, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): byte ranges of the words, and for each text the range of its words."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = translate(data, word).view(bool)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begin[edges] = inside[edges]
    end[edges[1:] - 1] = inside[edges[1:] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; the ranges ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + WINDOW, "right")))
        last = ends[to - 1]
        up, down = _power_tables(int(last - base) + 1)
        total = np.zeros(int(last - base) + 1, np.uint64)
        np.cumsum(data[base:last] * up[: last - base], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * U64(0xD6E8FEB86659FD93))
        at = to
    return out


def word_hashes(column: pa.Array, word: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, for each text the range of its words)."""
    data, offsets = column_bytes(column)
    if lower:
        data = translate(data, LOWER)
    starts, ends, bounds = cut_words(data, offsets, word)
    return hash_spans(data, starts, ends), bounds


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of k consecutive words at each place (text bounds not regarded)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= U64(0xA0761D6478BD642F)
        h += words[j : j + n]
    return mix(h ^ U64(k))


def shingle_sets(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each text, end to end, and the range of each text.

    A text of fewer than k words, but at least one, has its whole sequence as its one shingle.
    """
    counts = np.diff(bounds)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    to = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(to[-1], np.uint64)
    every = grams(words, k)
    for i in np.flatnonzero(sizes):
        a, n = bounds[i], counts[i]
        part = out[to[i] : to[i + 1]]
        if n >= k:
            part[:] = every[a : a + n - k + 1]
            part.sort()
        else:
            part[0] = grams(words[a : a + n], int(n))[0]
    first = np.ones(len(out), bool)
    first[1:] = out[1:] != out[:-1]
    first[to[:-1][sizes > 0]] = True
    kept = np.concatenate(([0], np.cumsum(first)))
    return out[first], kept[to]


def spread(bounds: np.ndarray) -> np.ndarray:
    """For each item the number of the text that it belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
