"""Means of group elements by key, as sums that are added up where the elements are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lie
from .components import Scratch, save

ROUNDS = 20


def _keyed(df: DataFrame, by: list[str]) -> DataFrame:
    return df.where(F.col("params").isNotNull()).select(*by, "params")


def _rotations(group: lie.Group, df: DataFrame, by: list[str]) -> DataFrame:
    """The main direction of the quaternions' outer products, and the geometric mean of the scales."""
    q = [F.col("params")[i] for i in range(4)]
    square = sum(x * x for x in q)
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = df.groupBy(*by).agg(*[F.sum(F.try_divide(q[i] * q[j], square)).alias(f"s{i}{j}") for i, j in pairs], F.avg(F.log(square)).alias("scale"))

    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            m = np.zeros((4, 4))
            for (i, j), v in zip(pairs, row[:-1], strict=True):
                m[i, j] = m[j, i] = v
            out.append((lie.mean_rotation(m) * (np.exp(row[-1] / 2) if group.scales else 1.0)).tolist())
        return pd.Series(out)

    mean = F.pandas_udf(run, "array<double>")(*[F.col(f"s{i}{j}") for i, j in pairs], F.col("scale"))
    return sums.select(*by, mean.alias("params"))


def average(elements: DataFrame, group: str, by: list[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(by, params) of the mean element of each key; elements: params array<double> as `lie.Group.params` gives them.

    Vectors have their arithmetic mean and rotations (with or without scale) in three dimensions a closed form. The others
    start from one element and add the mean of the logarithms to it, once where the group commutes, else until the step's
    square is under 1e-10; where it isn't after so many rounds, the mean is null. Rows with null parameters don't count.
    """
    g, by = lie.GROUPS[group], by or []
    rows = _keyed(elements, by)
    if group == "r3":
        return rows.groupBy(*by).agg(*[F.avg(F.col("params")[i]).alias(f"m{i}") for i in range(3)]).select(*by, F.array("m0", "m1", "m2").alias("params"))
    if group in ("so3", "rxso3"):
        return _rotations(g, rows, by)
    with Scratch(elements.sparkSession) as scratch:
        return _iterated(g, group, rows, by, rounds, scratch)


def _iterated(g, group: str, rows: DataFrame, by: list[str], rounds: int, scratch: Scratch) -> DataFrame:
    own = scratch.keep(rows)
    names = {c: f"__by_{c}" for c in by}
    now = scratch.keep(own.groupBy(*by).agg(F.min("params").alias("mean")).withColumn("open", F.lit(True)))
    commutes = group in ("so2", "rxso2")

    def away(mean: pd.Series, params: pd.Series) -> pd.Series:
        return pd.Series([g.log(g.inverse(g.from_params(a)) @ g.from_params(b)).tolist() for a, b in zip(mean, params, strict=True)])

    def moved(mean: pd.Series, step: pd.Series) -> pd.Series:
        return pd.Series([g.params(g.from_params(a) @ g.exp(s)).tolist() for a, s in zip(mean, step, strict=True)])

    difference, shift = F.pandas_udf(away, "array<double>"), F.pandas_udf(moved, "array<double>")
    for _ in range(1 if commutes else rounds):
        live = now.where("open").select(*[F.col(c).alias(n) for c, n in names.items()], "mean")
        met = own.join(live, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]) if by else own.join(F.broadcast(live))
        logs = met.select(*names.values(), difference("mean", "params").alias("d"))
        steps = logs.groupBy(*names.values()).agg(*[F.avg(F.col("d")[i]).alias(f"s{i}") for i in range(g.dof)])
        vector: Column = F.array(*[f"s{i}" for i in range(g.dof)])
        square = sum(F.col(f"s{i}") * F.col(f"s{i}") for i in range(g.dof))
        after = now.join(steps, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left") if by else now.join(F.broadcast(steps))
        go = F.col("open") & F.col("s0").isNotNull()
        at = after.select(*by, "mean", "open", go.alias("go"), F.when(go, vector).otherwise(F.array(*[F.lit(0.0)] * g.dof)).alias("step"), square.alias("square"))
        still = F.col("go") & (F.col("square") >= lie.EPSILON) & F.lit(not commutes)
        then = scratch.keep(at.select(*by, F.when(F.col("go"), shift("mean", "step")).otherwise(F.col("mean")).alias("mean"), still.alias("open")))
        scratch.drop(now)
        now = then
        if not now.where("open").limit(1).count():
            break
    return save(now.select(*by, F.when(~F.col("open"), F.col("mean")).alias("params")))
