"""Merkle manifest of a dataset, and a recursive query that proves every row of it.

A leaf is the hash of a row's columns. Each source's leaves, by id, are hashed three at a time until one node remains
(its subroot); the subroots, by source, likewise until the root. `manifest` builds the levels and stores them as node
rows, each linked to its parent and holding its siblings to the left and right; `climb` is a recursive query over them:
it ascends from every leaf, appends the siblings that it meets and folds the hash of a row, tampered or not.

Chunks of 729 = 3**6 consecutive leaves of a source keep the climb even: a node row's key is (chunk, slot), and a node
above a chunk has a row for each chunk below it (1/729 of the leaves for each such level). The query runs twice: leaves
climb to the top of their chunk, and chunks from there to the root, as all leaves of a chunk meet the same siblings there;
a leaf's hash is then folded with these too. So a leaf takes six rounds at most, however large its source is, no key
meets more than 729 climbing rows, and a source that holds a third of all rows is like any other. Chunks are built in one
aggregation; only the levels above them, 1/729 of all nodes, are built one by one. The node rows are bucketed by their
key: a round of the climb moves the climbing rows, not the nodes. A round carries 32 bytes of hash for each leaf; siblings
are appended as rows, and put together by one aggregation in the end.

Results for odd input: null columns count as `-`; a null source is a source of its own (the first), null ids come first
in their source; repeated rows have a leaf and a proof each (of equal ids, leaves ascend by hash); a source of one row is
its own subroot, a table of one source has that as its root, and a proof without siblings is the hash of nothing; an
empty table gives no rows; other columns are not covered.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import Scratch, save, tidy
from ..operators.ranking import row_numbers

COVERED = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
BOTTOM = 6  # levels of a chunk
CHUNK = FAN**BOTTOM
ABOVE = BOTTOM * CHUNK  # slots from here on are above the chunk
SHIFT = 31  # a chunk's number is its source's, then 31 bits


def leaf_hash(columns: list[Column]) -> Column:
    """The digest of values, each as `-` if null, else its length in bytes, `:`, and itself."""
    parts = []
    for c in columns:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hex(x: str) -> str:
    return f"lower(hex({x}))"


def _joined(array: str) -> str:
    return f"aggregate({array}, cast('' as binary), (acc, y) -> concat(acc, y))"


def _hash_of(array: str) -> str:
    return f"unhex(sha2({_hex(_joined(array))}, 256))"


def _height(n: str) -> str:
    """Levels until one of n nodes remains."""
    return "(" + " + ".join(f"int({n} > {FAN**k})" for k in range(39)) + ")"


def _levels(nodes: DataFrame, height: int, scratch: Scratch) -> tuple[DataFrame | None, DataFrame]:
    """(runs (s, level, pos, kids), tops (s, digest)) of trees over nodes (s, pos, h, digest), h levels high, height at most."""
    runs, tops, now = None, nodes.where("h = 0").select("s", "digest"), nodes
    for level in range(height):
        kids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        own = now.where(f"h > {level}").withColumn("__run", F.expr(f"pos div {FAN}"))
        made = scratch.keep(own.groupBy("s", "__run").agg(kids.alias("kids"), F.first("h").alias("h")).select("s", F.col("__run").alias("pos"), "kids", "h").withColumn("digest", F.expr(_hash_of("kids"))))
        step = made.select("s", F.lit(level).alias("level"), "pos", "kids")
        runs = step if runs is None else runs.unionByName(step)
        tops = tops.unionByName(made.where(f"h = {level + 1}").select("s", "digest"))
        now = made
    return runs, tops


def manifest(docs: DataFrame, scratch: Scratch, key: str = "doc_id", by: str = "source", covered: tuple[str, ...] = COVERED, tampered: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, bytes]:
    """(leaves (doc_id, chunk, idx, leaf, claimed, slot), nodes (chunk, slot, parent, left, right) inside chunks, those above
    chunks, chunks (chunk, digest, subroot), root).

    tampered: columns as someone claims them, for `claimed`; the leaf itself if they don't differ.
    """
    changed = tampered or {}
    hashed = docs.select(
        F.col(key).alias("doc_id"),
        F.col(by).cast("string").alias("source"),
        leaf_hash([F.col(c) for c in covered]).alias("leaf"),
        leaf_hash([changed.get(c, F.col(c)) for c in covered]).alias("claimed"),
    )
    order = ["source", "doc_id", "leaf"]
    hashed = scratch.keep(hashed)
    placed = hashed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    dealt = scratch.keep(placed.withColumn("__part", F.shiftright("__id", 33)))
    scratch.drop(hashed)
    sizes = scratch.keep(dealt.groupBy("source", "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__size")))
    sources = row_numbers(sizes.groupBy("source").agg(F.sum("__size").alias("n")), ["source"], "s").select(F.col("source").alias("__named"), "n", (F.col("s") - 1).alias("s"))
    before = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__offset", F.coalesce(F.sum("__size").over(before), F.lit(0))).join(sources, F.col("source").eqNullSafe(F.col("__named")))
    starts = scratch.keep(starts.select(F.col("source").alias("__of"), F.col("__part").alias("__in"), "__first", "__offset", "n", "s"))
    pos = F.col("__id") - F.col("__first") + F.col("__offset")
    placed = dealt.join(starts, dealt["source"].eqNullSafe(starts["__of"]) & (dealt["__part"] == starts["__in"])).withColumn("__pos", pos)
    chunk = F.expr(f"s * {1 << SHIFT} + __pos div {CHUNK}")
    leaves = scratch.keep(placed.select("doc_id", chunk.alias("chunk"), F.expr(f"cast(__pos % {CHUNK} as int)").alias("idx"), "leaf", "claimed", F.expr(_height("n")).alias("h")).withColumn("slot", F.when(F.col("h") > 0, F.col("idx")).otherwise(ABOVE)))
    scratch.drop(dealt)

    # the levels of each chunk
    nxt = f"transform(sequence(0, (size(element_at(acc, -1)) + {FAN - 1}) div {FAN} - 1), i -> {_hash_of(f'slice(element_at(acc, -1), int(i) * {FAN} + 1, {FAN})')})"
    grouped = leaves.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "leaf"))).alias("own"), F.first("h").alias("h"))
    built = grouped.select("chunk", "h", F.least("h", F.lit(BOTTOM)).alias("own_h"), F.expr("transform(own, x -> x.leaf)").alias("own"))
    climbed = F.expr(f"if(own_h = 0, array(own), aggregate(sequence(1, own_h), array(own), (acc, k) -> array_append(acc, {nxt})))")
    chunks = scratch.keep(built.select("chunk", "h", "own_h", climbed.alias("levels")))
    node = f"""named_struct('slot', cast(l * {CHUNK} + i as int), 'parent', cast(if(l + 1 = own_h, {ABOVE}, (l + 1) * {CHUNK} + i div {FAN}) as int),
        'left', {_joined(f'slice(a, i - i % {FAN} + 1, i % {FAN})')}, 'right', {_joined(f'slice(a, i + 2, {FAN - 1} - i % {FAN})')})"""
    inner = chunks.selectExpr("chunk", f"inline(flatten(transform(slice(levels, 1, own_h), (a, l) -> transform(a, (x, i) -> {node}))))")

    # the levels above: of each source, then of all subroots
    roots = chunks.selectExpr("chunk", f"chunk div {1 << SHIFT} as s", f"chunk % {1 << SHIFT} as pos", f"greatest(h - {BOTTOM}, 0) as h", "element_at(levels, -1)[0] as digest")
    roots = scratch.keep(roots)
    above = int(roots.agg(F.max("h")).first()[0] or 0)
    runs, subroots = _levels(roots, above, scratch)
    subroots = scratch.keep(subroots)
    count = subroots.count()
    high = sum(count > FAN**k for k in range(39))
    upper, top = _levels(subroots.select(F.lit(-1).cast("long").alias("s"), F.col("s").alias("pos"), F.lit(high).alias("h"), "digest"), high, scratch)
    root = bytes(top.first().digest) if count else b""
    runs = [r for r in (runs, upper) if r is not None]
    if runs:
        steps = [f"transform(sequence(0, h - 1), k -> named_struct('of', s, 'level', int(k), 'at', pos div cast(pow({FAN}, k) as long), 'k', int(k)))"]
        steps_top = f"transform(sequence(0, {high} - 1), k -> named_struct('of', -1L, 'level', int(k), 'at', s div cast(pow({FAN}, k) as long), 'k', int(h + k)))"
        path = f"concat(if(h > 0, {steps[0]}, array()), {steps_top if high else 'array()'})"
        asked = roots.selectExpr("chunk", f"inline({path})")
        made = runs[0] if len(runs) == 1 else runs[0].unionByName(runs[1])
        made = made.select(F.col("s").alias("of"), "level", F.col("pos").alias("run"), "kids")
        place = F.expr(f"int(at % {FAN})")
        outer = asked.withColumn("run", F.expr(f"at div {FAN}")).join(made, ["of", "level", "run"]).withColumn("i", place)
        outer = outer.selectExpr("chunk", f"int({ABOVE} + k) as slot", f"int({ABOVE} + k + 1) as parent", f"{_joined('slice(kids, 1, i)')} as left", f"{_joined(f'slice(kids, i + 2, {FAN})')} as right")
    else:
        outer = inner.where("false")
    inner = scratch.keep(inner)
    named = roots.join(subroots.withColumnRenamed("digest", "subroot"), "s").select("chunk", "digest", "subroot")
    scratch.drop(chunks)
    return leaves.drop("h"), inner, outer, named, root


@contextmanager
def unlimited_recursion(spark: SparkSession) -> Iterator[None]:
    """Recursive queries may give any number of rows: here, one for each leaf and level."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def climb(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chunk, idx, path, folded): from each start (chunk, idx, slot, digest) as far up as there are nodes (a table, bucketed
    by chunk and slot): the siblings (step, left, right) met on the way, and the digest folded with them.

    Its plan runs while `unlimited_recursion` holds.
    """
    steps = starts.sparkSession.sql(
        f"""
        WITH RECURSIVE climb(chunk, idx, step, slot, left, right, folded) AS (
          SELECT chunk, idx, 0, slot, cast('' as binary), cast('' as binary), digest FROM {{starts}}
          UNION ALL
          SELECT c.chunk, c.idx, c.step + 1, n.parent, n.left, n.right, unhex(sha2(concat({_hex('n.left')}, {_hex('c.folded')}, {_hex('n.right')}), 256))
          FROM climb c JOIN {{nodes}} n ON c.chunk = n.chunk AND c.slot = n.slot)
        SELECT * FROM climb""",
        starts=starts.select("chunk", "idx", "slot", "digest"),
        nodes=nodes,
    )
    met = F.array_sort(F.collect_list(F.when(F.col("step") > 0, F.struct("step", "left", "right"))))
    return steps.repartition("chunk").groupBy("chunk", "idx").agg(met.alias("path"), F.max_by("folded", "step").alias("folded"))


class NodeTable:
    """Node rows as a table that is bucketed by its key, so that no climb moves them."""

    def __init__(self, nodes: DataFrame, scratch: Scratch):
        self.spark, self.name = nodes.sparkSession, f"merkle_nodes_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        nodes.repartition(buckets, "chunk", "slot").write.bucketBy(buckets, "chunk", "slot").sortBy("chunk", "slot").option("path", f"{scratch.folder}/{self.name}").saveAsTable(self.name)

    def __enter__(self) -> DataFrame:
        return self.spark.table(self.name)

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def prove(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row; digests as lowercase hex."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    try:
        with tidy(spark):
            leaves, inner, outer, chunks, root = manifest(docs, scratch, tampered=tampered)
            outer, chunks = scratch.keep(outer), scratch.keep(chunks)
            table = NodeTable(inner, scratch)
            scratch.drop(inner)
        with table as nodes, unlimited_recursion(spark):
            # few rows, whose nodes are not worth buckets
            above = scratch.keep(climb(chunks.select("chunk", F.lit(0).alias("idx"), F.lit(ABOVE).alias("slot"), "digest"), outer).select("chunk", F.col("path").alias("above")))
            above = above.join(chunks, "chunk").select("chunk", "above", "subroot")
            own = climb(leaves.withColumnRenamed("claimed", "digest"), nodes)
            proof = F.expr(_joined("transform(concat(path, above), x -> concat(x.left, x.right))"))
            folded = F.expr(f"aggregate(above, folded, (acc, x) -> unhex(sha2(concat({_hex('x.left')}, {_hex('acc')}, {_hex('x.right')}), 256)))")
            proved = scratch.keep(own.join(above, "chunk").select("chunk", "idx", F.unhex(F.sha2(F.lower(F.hex(proof)), 256)).alias("proof"), folded.alias("folded"), "subroot"))
        h = lambda c: F.lower(F.hex(c))
        out = leaves.join(proved, ["chunk", "idx"])
        out = out.select("doc_id", h("leaf").alias("leaf"), h("subroot").alias("subroot"), F.lit(root.hex()).alias("root"), h("proof").alias("proof_sha256"), h("folded").alias("folded_root"))
        with tidy(spark):
            return save(out.withColumn("verified", F.col("folded_root") == F.col("root")))
    finally:
        scratch.clear()


def without_newlines(share: int = 2) -> dict[str, Column]:
    """The text without its newlines, where `share` divides the id's checksum."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % share == 0
    return {"text": F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
