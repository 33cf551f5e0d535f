"""Edit-aware token counts.

A text is cut into pre-tokens (the pattern of the vocabulary), which are encoded independently. A document keeps a
segment tree over them: leaves hold up to LEAF pre-tokens (characters and tokens of each), inner nodes the sums of two
children. An edit finds its place by descending on character sums, cuts pre-tokens anew from a little before the edit
(the pattern looks at most CONTEXT characters ahead of a pre-token's end) until a new border falls on an old one behind
it, and encodes those alone; then only the sums above the touched leaves are added again.

`build` makes trees, to be kept as a table beside the texts: one varint of characters and one of tokens for each
pre-token, with the leaves' lengths before them (`pack`). `apply_edits` takes such a table and a column of edits, changes
texts and trees, and reports the work; its result is a table of the same kind, for the next edits. A tree that doesn't
fit its text (of another vocabulary, or damaged) is an error.

Edits are applied in order, each to the text that the one before left; start and stop count code points and are cut to
the text. Results for odd input: a null text counts as empty and has 0 tokens; null edits, or null entries, change
nothing; a null replacement is empty; a stop before the start counts as the start; texts and pre-tokens of any length
are used whole; equal rows get equal results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import Scratch, save
from . import _text as T

U64 = np.uint64

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the vocabulary's public pre-token pattern
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTEXT = 3
LEAF = 64
CACHE = 1 << 17


class Encoder:
    """Tokens of a pre-token, with those of frequent ones kept."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN).finditer
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= CACHE:
                self.known.clear()
            if len(piece) < 64:
                self.known[piece] = n
        return n


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_held: list[tuple[dict[bytes, int], Encoder]] = []


def _encoder(ranks: dict[bytes, int]) -> Encoder:
    """The worker's encoder for a vocabulary."""
    if not _held or _held[0][0] is not ranks:
        _held[:] = [(ranks, Encoder(ranks))]
    return _held[0][1]


class Tree:
    """Leaves of [(characters, tokens), ...] under a heap-ordered array of (characters, tokens) sums."""

    def __init__(self, leaves: list[list[tuple[int, int]]]):
        self.leaves = leaves or [[]]
        self._grow()

    @classmethod
    def of(cls, text: str, encoder: Encoder) -> Tree:
        pieces = [(len(p), encoder.count(p)) for p in (m[0] for m in encoder.cut(text))]
        return cls([pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)])

    def _grow(self) -> None:
        self.base = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.sums = [(0, 0)] * (2 * self.base)
        for i, leaf in enumerate(self.leaves):
            self.sums[self.base + i] = (sum(c for c, _ in leaf), sum(t for _, t in leaf))
        for i in range(self.base - 1, 0, -1):
            (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (a + c, b + d)

    @property
    def chars(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, characters before it) of the leaf that holds a character, or the last leaf."""
        node, before = 1, 0
        at = min(at, max(self.chars - 1, 0))
        while node < self.base:
            left = self.sums[2 * node][0]
            node *= 2
            if at - before >= left and self.sums[node + 1][0]:
                before, node = before + left, node + 1
        return node - self.base, before

    def put(self, first: int, last: int, pieces: list[tuple[int, int]]) -> None:
        """Replaces the pre-tokens of leaves first .. last; sums change on the paths above these only."""
        if len(pieces) > 4 * LEAF * (last - first + 1):  # too many for these leaves: the tree is laid out again
            self.leaves[first : last + 1] = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
            self._grow()
            return
        n = last - first + 1
        each = -(-len(pieces) // n) if pieces else 0
        touched = set()
        for k in range(n):
            leaf = pieces[k * each : (k + 1) * each]
            self.leaves[first + k] = leaf
            self.sums[self.base + first + k] = (sum(c for c, _ in leaf), sum(t for _, t in leaf))
            touched.add((self.base + first + k) // 2)
        while touched and touched != {0}:
            for i in touched:
                (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
                self.sums[i] = (a + c, b + d)
            touched = {i // 2 for i in touched}


def edit(text: str, tree: Tree, start: int, stop: int, new: str, encoder: Encoder) -> tuple[str, int]:
    """(the new text, pre-tokens encoded); the tree is changed in place."""
    start = max(0, min(start, len(text)))
    stop = max(start, min(stop, len(text)))
    out = text[:start] + new + text[stop:]
    shift = len(out) - len(text)
    first, before = tree.find(max(0, start - CONTEXT))
    # pre-tokens that end well before the edit stay
    head, at = [], before
    for piece in tree.leaves[first]:
        if at + piece[0] + CONTEXT > start:
            break
        head.append(piece)
        at += piece[0]
    last, _ = tree.find(stop)
    # old borders from the place on where cutting begins
    borders, k, leaf, tail = at, len(head), first, []
    made: list[tuple[int, int]] = []
    new_stop = start + len(new)
    met = False
    for m in encoder.cut(out, at):
        # moves the old border up to this pre-token's begin
        while borders + shift < m.start() or leaf < last or borders < stop:
            if k < len(tree.leaves[leaf]):
                borders += tree.leaves[leaf][k][0]
                k += 1
            elif leaf + 1 < len(tree.leaves):
                leaf, k = leaf + 1, 0
            else:
                break
        if m.start() >= new_stop and borders >= stop and borders + shift == m.start() and m.start() > at - 1 and leaf >= last:
            met = True
            break
        made.append((m.end() - m.start(), encoder.count(m[0])))
    if met:
        tail = tree.leaves[leaf][k:]
    else:
        leaf = len(tree.leaves) - 1
    tree.put(first, leaf, head + made + tail)
    return out, len(made)


EDITS = "array<struct<start:int,stop:int,text:string>>"


def _varints(values: np.ndarray) -> bytes:
    """Numbers in groups of seven bits, the lowest first; all but the last byte of a number have the top bit."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 35, 7):
        sizes += values >= U64(1 << bits)
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - sizes
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        out[starts[own] + k] = ((values[own] >> U64(7 * k)) & U64(0x7F)).astype(np.uint8) | np.where(sizes[own] > k + 1, 0x80, 0).astype(np.uint8)
    return out.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 0x80
    starts = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 0x7F).astype(np.int64) << (7 * place), starts)


def pack(tree: Tree) -> bytes:
    """A tree as bytes: the number of leaves, their lengths, then characters and tokens of all pre-tokens."""
    flat = np.array([x for leaf in tree.leaves for piece in leaf for x in piece], np.int64)
    return _varints(np.concatenate((np.array([len(tree.leaves), *map(len, tree.leaves)], np.int64), flat)))


def unpack(data: bytes | None) -> Tree:
    numbers = _numbers(data or b"").tolist()
    if not numbers:
        return Tree([])
    n = numbers[0]
    flat = list(zip(numbers[1 + n :: 2], numbers[2 + n :: 2], strict=True))
    leaves, at = [], 0
    for size in numbers[1 : 1 + n]:
        leaves.append(flat[at : at + size])
        at += size
    return Tree(leaves)


_BUILT = "text string, n_tokens long, n_pretokens long, tree binary"


def build(docs: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """(doc_id, text, n_tokens, n_pretokens, tree): the trees to keep beside the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks or load_ranks())

    def run(batches):
        e = _encoder(shared.value)
        for batch in T.pieces_of(batches):
            trees = [Tree.of(t or "", e) for t in batch.column("text").to_pylist()]
            columns = [pa.array([t.tokens for t in trees], pa.int64()), pa.array([sum(map(len, t.leaves)) for t in trees], pa.int64()), pa.array([pack(t) for t in trees], pa.binary())]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text"), *columns], ["doc_id", "text", "n_tokens", "n_pretokens", "tree"])

    return T.bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {_BUILT}")


def _edited(text: str | None, tree: Tree, edits: Iterable[dict] | None, e: Encoder) -> tuple[str | None, int]:
    work = 0
    for x in edits or ():
        if x and x["start"] is not None:
            text, n = edit(text or "", tree, x["start"], x["start"] if x["stop"] is None else x["stop"], x["text"] or "", e)
            work += n
    return text, work


def apply_edits(trees: DataFrame, edits: Column, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """The columns of `build` after the edits (EDITS) of each row, and n_edits and n_reencoded: entries of the edits, and
    pre-tokens that were encoded for them."""
    shared = trees.sparkSession.sparkContext.broadcast(ranks or load_ranks())
    names = ["doc_id", *(x.split()[0] for x in _BUILT.split(", ")), "n_edits", "n_reencoded"]

    def run(batches):
        e = _encoder(shared.value)
        for batch in T.pieces_of(batches):
            out = []
            for text, tree, own in zip(*(batch.column(c).to_pylist() for c in ("text", "tree", "edits")), strict=True):
                tree = unpack(tree)
                if tree.chars != len(text or ""):
                    raise ValueError("a stored tree doesn't fit its text")
                text, work = _edited(text, tree, own, e)
                out.append((text, tree.tokens, sum(map(len, tree.leaves)), pack(tree), len(own or ()), work))
            types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names)

    given = T.bounded(trees).select("doc_id", "text", "tree", edits.cast(EDITS).alias("edits"))
    return given.mapInArrow(run, f"doc_id {dict(trees.dtypes)['doc_id']}, {_BUILT}, n_edits int, n_reencoded long")


def count_edited(docs: DataFrame, edits: Column, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_edits, n_reencoded, n_tokens_edited): counts by trees that are built, written as a
    table, and read again for the edits, which `edits` makes from the columns of that table."""
    ranks = ranks or load_ranks()
    scratch = Scratch(docs.sparkSession)
    kept = scratch.keep(build(docs, ranks).withColumnsRenamed({"n_tokens": "__tokens", "n_pretokens": "__pretokens"}))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    names = ["doc_id", "n_tokens", "n_pretokens", "n_edits", "n_reencoded", "n_tokens_edited"]

    def run(batches):
        e = _encoder(shared.value)
        for batch in T.pieces_of(batches):
            n, again, after = [], [], []
            for text, tree, own in zip(*(batch.column(c).to_pylist() for c in ("text", "tree", "edits")), strict=True):
                tree = unpack(tree)
                n.append(len(own or ()))
                again.append(_edited(text, tree, own, e)[1])
                after.append(tree.tokens)
            yield pa.record_batch([batch.column("doc_id"), batch.column("__tokens"), batch.column("__pretokens"), pa.array(n, pa.int32()), pa.array(again, pa.int64()), pa.array(after, pa.int64())], names)

    given = T.bounded(kept).select("doc_id", "__tokens", "__pretokens", "text", "tree", edits.cast(EDITS).alias("edits"))
    try:
        return save(given.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, n_pretokens long, n_edits int, n_reencoded long, n_tokens_edited long"))
    finally:
        scratch.clear()


def revision(text: Column) -> Column:
    """Three edits for a text: a note inserted after its first quarter, ten characters of its middle cut, and a
    character of its last quarter replaced."""
    n = F.coalesce(F.length(text), F.lit(0))
    row = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), F.lit(t).alias("text"))
    quarter, half, late = F.floor(n / 4), F.floor(n / 2), F.floor(n * 3 / 4)
    return F.array(row(quarter, quarter, " [noted] "), row(half, half + 10, ""), row(late, late + 1, "X"))
