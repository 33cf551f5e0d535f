"""Trajectory analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from .ranking import row_numbers


def numbered(trajectory: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds `row`, from 1 in the order of time, within each path named by `by` or over the whole table."""
    order = ["ts", "tx", "ty", "tz"]
    if not by:
        return row_numbers(trajectory, order).withColumn("row", F.col("row").cast("int"))
    return trajectory.withColumn("row", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def align_start(trajectory: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Positions less the first one."""
    by = by or []
    first = trajectory.groupBy(*by).agg(F.min(F.struct("ts", "tx", "ty", "tz")).alias("__first"))
    names = {c: f"__by_{c}" for c in by}
    start = first.select(*[F.col(c).alias(n) for c, n in names.items()], "__first")
    met = trajectory.join(start, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]) if by else trajectory.join(F.broadcast(start))
    return met.withColumns({c: F.col(c) - F.col(f"__first.{c}") for c in ("tx", "ty", "tz")}).drop("__first", *names.values())


def with_heading(trajectory: DataFrame) -> DataFrame:
    """Adds hx, hy, hz: the viewing direction of each pose (columns qx .. qw)."""
    h = G.heading(F.struct("qx", "qy", "qz", "qw"))
    return trajectory.withColumns({"hx": h.x, "hy": h.y, "hz": h.z})


def rmse(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, rmse) of positions, row by row in the order of time; rmse is null if the lengths differ."""
    by = by or []
    left, right = (numbered(t, by).select(*by, "row", *[F.col(c).alias(f"{c}{i}") for c in ("tx", "ty", "tz")]) for i, t in ((1, a), (2, b)))
    square = sum((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in ("tx", "ty", "tz"))
    met = left.join(right, [*by, "row"], "full_outer").groupBy(*by).agg(F.count("*").alias("n"), F.count(square).alias("both"), F.sqrt(F.avg(square)).alias("value"))
    return met.select(*by, "n", F.when(F.col("n") == F.col("both"), F.col("value")).alias("rmse"))


def plot_data(trajectory: DataFrame, every: int = 10) -> DataFrame:
    """Positions with the headings of each so many-th pose, for a plot."""
    rows = numbered(with_heading(trajectory))
    shown = (F.col("row") - 1) % every == 0
    return rows.withColumns({c: F.when(shown, F.col(c)) for c in ("hx", "hy", "hz")})
