"""Row numbers over a whole table, without a window over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import save


def row_numbers(rows: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """Adds `name`: the place of each row, from 1, in the order of the columns; rows equal in these are interchangeable.

    Rows are dealt by range, counted by part, and the parts' offsets (one row each) are added. Nulls stand first.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    dealt = save(placed).withColumn("__part", F.shiftright("__id", 33))  # written: both readings see the same parts
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", "__first", F.coalesce(before, F.lit(0)).alias("__offset"))
    return dealt.join(F.broadcast(starts), "__part").withColumn(name, F.col("__id") - F.col("__first") + F.col("__offset") + 1).drop("__id", "__part", "__first", "__offset")
