"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

All words are shared among the sources by weight. A source whose share is above `epochs` times its size is clamped there
and what it leaves is shared again by weight, until no share is above. The clamped sources are always those with the
least size for their weight, so a round is one aggregate over one row for each source, and its state two numbers.

A source's target of e epochs takes each of its documents floor(e) times, and once more those that stand first in a
seeded order, as far as their words fit; then, among the others, those that fit in what is left. A source's taken words
never exceed its target, and fall short of it by less than one document that didn't fit.

The order is dealt by range over many tasks and words before each row are summed by part, so a source with a third of
all rows has no task of its own. DataFrame functions only.

Results for odd input: a null source is one source, the last; null and empty texts have size 0 and are never taken (0
words); null ids and repeated rows are ordered like others, and rows equal in id and size are interchangeable; an empty
table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import Scratch, save, tidy
from ..operators.ranking import row_numbers

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = 17


def water_level(sources: DataFrame, total: int, epochs: int) -> tuple[int, int]:
    """(words, weight): what is left for the sources below their caps, and the weight that shares it; (0, 0) if none is.

    sources: (weight, source_size), a row for each source.
    """
    left, weight = total, int(sources.agg(F.sum("weight")).first()[0] or 0)
    while weight:
        above = F.expr(f"cast(weight as decimal(19,0)) * {left}BD > cast({epochs} * source_size as decimal(19,0)) * {weight}BD")
        clamped, free = sources.agg(F.sum(F.when(above, F.col("source_size") * epochs)), F.sum(F.when(~above, F.col("weight")))).first()
        if int(free or 0) == weight:
            break
        left, weight = total - int(clamped or 0), int(free or 0)
    return (left, weight) if weight else (0, 0)


def _before(rows: DataFrame, size) -> DataFrame:
    """Adds __upto: words of `size` of a source's rows up to this one, in the order of their places."""
    own = Window.partitionBy("__s", "__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("__s").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("__s", "__part").agg(F.sum(size).alias("__n"))
    starts = parts.select("__s", "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    return rows.withColumn("__own", F.sum(size).over(own)).join(starts, ["__s", "__part"]).withColumn("__upto", F.col("__own") + F.col("__start")).drop("__own", "__start")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, by: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, repeats): each document, and how often the mix takes it."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    try:
        with tidy(spark):
            sized = scratch.keep(
                docs.select(
                    "doc_id",
                    F.col(by).cast("string").alias("source"),
                    F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
                    F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))).alias("__h"),
                )
            )
            sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("__last", F.col("source").isNull())
            place = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("__s") - 1, F.lit(len(weights))) + 1).cast("int"))
            sources = scratch.keep(row_numbers(sources, ["__last", "source"], "__s").withColumn("weight", place.cast("long")).drop("__last"))
            total = int(sources.agg(F.sum("source_size")).first()[0] or 0)
            left, weight = water_level(sources, total, epochs)
            cap = F.expr(f"{epochs} * source_size")
            target = cap.cast("double")
            if weight:
                shared = F.expr(f"cast(cast(weight as decimal(19,0)) * {left}BD as double) / cast({weight} as double)")
                target = F.when(F.expr(f"cast(weight as decimal(19,0)) * {left}BD > cast({epochs} * source_size as decimal(19,0)) * {weight}BD"), target).otherwise(shared)
            shares = sources.withColumn("target", target).withColumn("__whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
            shares = shares.withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size")).withColumnRenamed("source", "__source")
            rows = sized.join(shares, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "weight")
            order = ["__s", "__h", "doc_id", "size"]
            placed = scratch.keep(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
            dealt = scratch.keep(placed.drop("__h").withColumn("__part", F.shiftright("__id", 33)))
            first = scratch.keep(_before(dealt, F.col("size")).withColumn("__once", (F.col("size") > 0) & (F.col("__upto") <= F.col("__rest"))).drop("__upto"))
            # what the first ones leave goes to those that fit in it
            gaps = first.groupBy("__s").agg((F.first("__rest") - F.sum(F.when(F.col("__once"), F.col("size")).otherwise(0))).alias("__gap"))
            fits = ~F.col("__once") & (F.col("size") > 0) & (F.col("size") <= F.col("__gap"))
            second = _before(first.join(gaps, "__s").withColumn("__fits", fits), F.when(F.col("__fits"), F.col("size")).otherwise(0))
            once = F.col("__once") | (F.col("__fits") & (F.col("__upto") <= F.col("__gap")))
            repeats = F.when(F.col("size") > 0, F.col("__whole") + once.cast("long")).otherwise(0).cast("long")
            out = second.withColumn("repeats", repeats).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")
            return save(out)
    finally:
        scratch.clear()
