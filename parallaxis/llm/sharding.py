"""Proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is (2 * rank - 1) / (2 * rows of
its source). All rows sorted by it mix the sources in proportion everywhere, so equal cuts of that order are shards
which all match the mixture: of each source, a shard holds its share up to about one row.

Both rankings are made without a window over a whole source or table: rows are dealt by range, counted by part, and
the parts' offsets are added, so a source that holds a third of all rows is spread over many parts.

Results for odd input: a null source is a source of its own, a null text has size 8 and checksum 0, null ids and
repeated rows are ranked like others (ties by id, size and checksum; rows equal in these are interchangeable), an
empty table gives no rows, other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import save

SEED = 17
SHARDS = 24


def _ranked(rows: DataFrame, order: list[str], within: list[str], rank: str) -> DataFrame:
    """Adds the rank (from 1) of each row in the order within each group, groups being leading columns of the order."""
    # a written table, so that a lost executor can't deal the rows anew between the two readings
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    dealt = save(placed.withColumn("__part", F.shiftright("__id", 33)))
    group = [*within, "__part"]
    # rows of a group are neighbours in a part, so ids count them
    sizes = dealt.groupBy(*group).agg(F.min("__id").alias("__first"), F.count("*").alias("__size"))
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    names = {c: f"__r_{i}" for i, c in enumerate(group)}
    right = offsets.select(*[F.col(c).alias(names[c]) for c in group], "__first", "__offset")
    on = [dealt[c].eqNullSafe(right[names[c]]) for c in group]
    joined = dealt.join(right, on)
    return joined.withColumn(rank, F.col("__id") - F.col("__first") + F.col("__offset") + 1).drop("__id", "__first", "__offset", "__part", *names.values())


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, by: str = "source") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot): every row has its shard and its place in it, from 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.col(by).cast("string").alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))).alias("__h"),
    )
    ties = ["__h", "doc_id", "size", "text_crc32"]
    inner = _ranked(rows, ["source", *ties], ["source"], "__rank")
    counts = inner.groupBy("source").agg(F.count("*").alias("__rows")).withColumnRenamed("source", "__source")
    with_share = inner.join(counts, inner["source"].eqNullSafe(counts["__source"])).withColumn("__share", (2 * F.col("__rank") - 1) / (2 * F.col("__rows"))).drop("__source", "__rows", "__rank")
    whole = _ranked(with_share, ["__share", *ties, "source"], [], "__place")
    total = whole.select(F.count("*").alias("__n"))
    place = F.col("__place") - 1
    shard = F.expr(f"(__place - 1) * {shards} div __n")
    # the first place p of shard s has p * shards >= s * n
    return (
        whole.crossJoin(F.broadcast(total))
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", (place - F.expr(f"(shard * __n + {shards - 1}) div {shards}")).cast("long"))
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot")
    )
