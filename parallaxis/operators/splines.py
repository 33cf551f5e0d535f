"""Cumulative cubic B-splines over tables: each time meets the four control elements around it in one equi-join."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lie


def evaluate(times: DataFrame, controls: DataFrame, group: str, start: float, step: float, by: list[str] | None = None) -> DataFrame:
    """times with value, first and second: the spline's element (as parameters) and its derivatives by time (the entries
    of the matrices, row by row); null outside the spline.

    controls: (by, i, params), i from 0 without gaps, two or more; times: (by, t, ...). The first and last elements are
    repeated at the ends.
    """
    g, by = lie.GROUPS[group], by or []
    w = Window.partitionBy(*by).orderBy("i")
    at = lambda n: F.coalesce(F.lag("params", 1).over(w) if n < 0 else F.lead("params", n).over(w), F.lead("params", 1).over(w) if n == 2 else F.col("params"))
    last = F.lead("i", 1).over(w).isNull()
    spans = controls.select(*by, F.col("i").alias("__i"), at(-1).alias("__a"), F.col("params").alias("__b"), F.lead("params", 1).over(w).alias("__c"), at(2).alias("__d"), last.alias("__last")).where("not __last")
    ends = controls.groupBy(*by).agg(F.max("i").alias("__end"))
    place = (F.col("t") - F.lit(start)) / F.lit(step)
    known = times.join(ends, by, "left") if by else times.join(F.broadcast(ends))
    inside = known.withColumn("__at", F.when((place >= 0) & (place <= F.col("__end")), place))
    # the last time belongs to the last span, at its end
    keyed = inside.withColumn("__i", F.least(F.floor("__at"), F.col("__end") - 1).cast("long")).withColumn("__u", F.col("__at") - F.col("__i"))
    met = keyed.join(spans.withColumn("__i", F.col("__i").cast("long")), [*by, "__i"], "left")

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, u: pd.Series) -> pd.DataFrame:
        out = []
        for *four, x in zip(a, b, c, d, u, strict=True):
            if x is None or x != x or any(v is None for v in four):
                out.append((None, None, None))
                continue
            value, first, second = g.segment([g.from_params(v) for v in four], float(x), step)
            out.append((g.params(value).tolist(), first.ravel().tolist(), second.ravel().tolist()))
        return pd.DataFrame(out, columns=["value", "first", "second"])

    found = F.pandas_udf(run, "value array<double>, first array<double>, second array<double>")("__a", "__b", "__c", "__d", "__u")
    return met.withColumn("__s", found).select(*times.columns, "__s.value", "__s.first", "__s.second")
