"""Robust triangulation: a landmark is the geometric median of the world points that its observations give."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import geometry as G
from .components import Scratch, save

MIN_OBSERVATIONS = 2
LISTED = 100_000  # points of a group that one task holds at most
CUT = 1 << 16  # points of small groups that are solved together


def geometric_median(points: np.ndarray, rounds: int = 50, tolerance: float = 1e-6) -> np.ndarray:
    """Weiszfeld's iteration from the mean; points nearer than 1e-9 to the estimate have no weight."""
    points = np.asarray(points, float)
    if len(points) == 1:
        return points[0]
    now = points.mean(0)
    for _ in range(rounds):
        far = np.sqrt(((points - now) ** 2).sum(1))
        near = far >= 1e-9
        weights = 1 / far[near]
        if weights.sum() < 1e-9:
            break
        after = (points[near] * weights[:, None]).sum(0) / weights.sum()
        step = np.sqrt(((after - now) ** 2).sum())
        now = after
        if step < tolerance:
            break
    return now


def geometric_medians(points: np.ndarray, sizes: np.ndarray, rounds: int = 50, tolerance: float = 1e-6) -> np.ndarray:
    """(3, len(sizes)): `geometric_median` of groups of points (3, n) that stand one after another, all in lockstep;
    NaN for an empty group. A group leaves the rounds as soon as its own iteration would end."""
    out = np.full((3, len(sizes)), np.nan)
    own = np.flatnonzero(sizes > 0)
    if not len(own):
        return out
    at = lambda n: np.cumsum(n) - n
    n = sizes[own]
    now = np.where(n > 1, np.add.reduceat(points, at(n), axis=1) / n, points[:, at(n)])
    out[:, own] = now
    go = n > 1
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            if not go.all():
                points, own, now, n = points[:, np.repeat(go, n)], own[go], now[:, go], n[go]
            if not len(own):
                break
            far = points - np.repeat(now, n, axis=1)
            far = np.sqrt(far[0] * far[0] + far[1] * far[1] + far[2] * far[2])
            weights = np.where(far >= 1e-9, 1 / far, 0.0)
            sums, total = np.add.reduceat(np.where(far >= 1e-9, points * weights, 0.0), at(n), axis=1), np.add.reduceat(weights, at(n))
            after = np.where(total < 1e-9, now, sums / total)
            step = after - now
            go = (total >= 1e-9) & ~(np.sqrt(step[0] * step[0] + step[1] * step[1] + step[2] * step[2]) < tolerance)
            now = after
            out[:, own] = now
    return out


def _cuts(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of groups of at most CUT points together, or one larger group each."""
    ends, out, at = np.cumsum(sizes), [], 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CUT, "right")))
        out.append((at, to))
        at = to
    return out


def _vectors(points: np.ndarray, known: np.ndarray | None = None) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(c) for c in points], "xyz", mask=None if known is None else pa.array(~known))


def _medians(lists: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    flat = lists.flatten()
    fields = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
    ends, out = np.cumsum(sizes), np.empty((3, len(sizes)))
    for a, b in _cuts(sizes):
        first = int(ends[a] - sizes[a])
        out[:, a:b] = geometric_medians(np.stack([fields[c].slice(first, int(ends[b - 1]) - first).to_numpy(zero_copy_only=False) for c in "xyz"]), sizes[a:b])
    return _vectors(out, sizes > 0)


def median_of(lists: str | Column) -> Column:
    """The geometric median of each row's list of (x, y, z) structs, in the list's order; null for an empty list."""
    return F.arrow_udf(_medians, StructType([StructField(c, DoubleType()) for c in "xyz"]))(lists)


def medians(points: DataFrame, by: str, listed: int = LISTED, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """(by, m): the geometric median of the points (x, y, z) of each group.

    Groups of up to `listed` points are sorted runs of rows, of which a task holds some at a time; larger ones are summed
    where their points are, round by round, until no estimate moves any more, so no task ever holds such a group.
    """
    sizes = points.groupBy(by).agg(F.count("*").alias("__n"))
    large = save(sizes.where(F.col("__n") > listed).select(F.col(by).alias("__large"), F.monotonically_increasing_id().alias("__g")))
    if not large.take(1):
        return _small_medians(points, by, rounds, tolerance)
    small = _small_medians(points.join(F.broadcast(large), F.col(by).eqNullSafe(F.col("__large")), "left_anti"), by, rounds, tolerance)
    with Scratch(points.sparkSession) as scratch:
        return _large_medians(points, by, large, small, rounds, tolerance, scratch)


def _small_medians(points: DataFrame, by: str, rounds: int, tolerance: float) -> DataFrame:
    """Medians of groups that a task may hold: rows come sorted in small batches, and leave once CUT of them are there."""
    kind = dict(points.dtypes)[by]
    runs = points.select(by, *[F.col(c).cast("double").alias(c) for c in "xyz"]).repartition(by).sortWithinPartitions(by, "x", "y", "z")

    def solve(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        found = geometric_medians(np.stack([table.column(c).to_numpy() for c in "xyz"]), np.diff(np.append(starts, table.num_rows)), rounds, tolerance)
        return pa.record_batch([table.column(0).combine_chunks().take(pa.array(starts)), _vectors(found)], [by, "m"])

    def run(batches):
        held, n, enough = [], 0, CUT
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= enough:
                table, starts = _runs(held)
                last = int(starts[-1])
                if last:
                    yield solve(table.slice(0, last), starts[:-1])
                # the last group may go on; one that fills all waits for as many rows again
                held, n = table.slice(last).to_batches(), table.num_rows - last
                enough = max(CUT, 2 * n)
        if n:
            yield solve(*_runs(held))

    return runs.mapInArrow(run, f"`{by}` {kind}, m struct<x:double,y:double,z:double>")


def _runs(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    """Batches as one table, and where each run of equal first columns starts."""
    table = pa.Table.from_batches(held).combine_chunks()
    ids = table.column(0).combine_chunks()
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    new = pc.coalesce(pc.not_equal(a, b), pc.not_equal(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    return table, np.flatnonzero(np.concatenate(([True], new)))


def _large_medians(points: DataFrame, by: str, large: DataFrame, small: DataFrame, rounds: int, tolerance: float, scratch: Scratch) -> DataFrame:
    # groups go by number: null is a group too, and meets nothing in a join
    own = scratch.keep(points.join(F.broadcast(large), F.col(by).eqNullSafe(F.col("__large"))).select("__g", "x", "y", "z"))
    now = scratch.keep(own.groupBy("__g").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"]).withColumn("moving", F.lit(True)))
    for _ in range(rounds):
        met = own.join(now.where("moving"), "__g")
        far = F.sqrt(sum((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "xyz"))
        w = F.when(far >= 1e-9, 1 / far)
        sums = met.withColumn("w", w).groupBy("__g").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(c)).alias(f"s{c}") for c in "xyz"])
        after = now.join(sums, "__g", "left").withColumn("go", F.col("moving") & (F.coalesce("w", F.lit(0.0)) >= 1e-9))
        to = {c: F.when(F.col("go"), F.try_divide(F.col(f"s{c}"), F.col("w"))).otherwise(F.col(f"m{c}")) for c in "xyz"}
        step = F.sqrt(sum((to[c] - F.col(f"m{c}")) * (to[c] - F.col(f"m{c}")) for c in "xyz"))
        then = scratch.keep(after.select("__g", *[to[c].alias(f"m{c}") for c in "xyz"], (F.col("go") & (step >= tolerance)).alias("moving")))
        scratch.drop(now)
        now = then
        if not now.where("moving").limit(1).count():
            break
    return save(small.unionByName(now.join(large, "__g").select(F.col("__large").alias(by), F.struct(*[F.col(f"m{c}").alias(c) for c in "xyz"]).alias("m"))))


def with_depth(observations: DataFrame, depth: str = "depth") -> DataFrame:
    return observations.where(F.col(depth) > 0)


def supported(observations: DataFrame, least: int = MIN_OBSERVATIONS) -> DataFrame:
    """Observations of the landmarks that have at least so many."""
    counted = observations.where("landmark_id is not null").withColumn("__n", F.count("*").over(Window.partitionBy("landmark_id")))
    return counted.where(F.col("__n") >= least).drop("__n")


def reprojection(observations: DataFrame, position, pose, k: G.Intrinsics) -> DataFrame:
    """Adds `error`: pixels between an observation and its landmark's projection; null if behind or without camera."""
    # a row from a list of one: filters on the error stay above it, else each of its uses would move the point anew
    moved = observations.select("*", F.inline(F.array(F.struct(G.act(pose, position).alias("__p")))))
    u, v = G.project(k, F.col("__p"))
    return moved.withColumns({"__u": u - F.col("px"), "__v": v - F.col("py")}).withColumn("error", F.sqrt(F.col("__u") * F.col("__u") + F.col("__v") * F.col("__v"))).drop("__p", "__u", "__v")


def observation_poses(observations: DataFrame, cameras: DataFrame, name: str = "pose") -> DataFrame:
    """Observations with the pose of their camera as `name`; those of unknown cameras stay, with null. One row a camera."""
    return observations.join(cameras.select("camera_id", F.col("pose").alias(name)), "camera_id", "left")


def triangulate(landmarks: DataFrame, observations: DataFrame, cameras: DataFrame, k: G.Intrinsics, threshold: float, column: str = "initial_position", depth: str = "depth") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(landmarks, observations, metrics) after one round.

    landmarks: (landmark_id, ...); observations: (landmark_id, camera_id, kp_idx, px, py, depth); cameras: (camera_id, pose
    world to camera). Observations without depth go; landmarks with fewer than two go; the median of the others'
    world points is the position; observations behind the camera or more than threshold pixels off go (those without
    a camera stay); landmarks with fewer than two go again. Positions aren't computed anew after that.
    """
    # poses are inverted once for each camera
    back = cameras.select("camera_id", F.when(F.col("pose").isNotNull(), G.inverse(F.col("pose"))).alias("pose"))
    posed = observation_poses(with_depth(observations, depth).where("landmark_id is not null"), back, "__back")
    world = F.when(F.col("__back").isNotNull(), G.act(F.col("__back"), G.back_project(k, F.col("px"), F.col("py"), F.col(depth))))
    others = [c for c in observations.columns if c not in ("landmark_id", "camera_id", "kp_idx")]
    # one list for each landmark: its observations are dealt once, and all that follows stays where they are
    lists = posed.withColumn("__w", world).groupBy("landmark_id").agg(F.sort_array(F.collect_list(F.struct("camera_id", "kp_idx", "__w", *others))).alias("obs")).where(F.size("obs") >= MIN_OBSERVATIONS)
    placed = lists.select("landmark_id", "obs", median_of(F.filter("obs.__w", lambda w: w.isNotNull())).alias("__position"))
    flat = placed.select("landmark_id", "__position", F.inline("obs")).drop("__w")
    checked = reprojection(observation_poses(flat, cameras, "__pose"), F.col("__position"), F.col("__pose"), k)
    keep = F.col("__pose").isNull() | F.col("__position").isNull() | (F.col("error").isNotNull() & (F.col("error") <= threshold))
    second = supported(checked.where(keep))
    left = second.groupBy("landmark_id").agg(F.first("__position").alias("__position"))
    old = F.col(column) if column in landmarks.columns else F.lit(None).cast("struct<x:double,y:double,z:double>")
    out = landmarks.join(left, "landmark_id").withColumn(column, F.coalesce("__position", old)).drop("__position")
    kept = second.select(*observations.columns)
    return out, kept, _metrics(landmarks, observations, checked.select("landmark_id", keep.alias("keep")), depth)


def _metrics(landmarks: DataFrame, observations: DataFrame, checked: DataFrame, depth: str) -> DataFrame:
    """(metric, value) of a round: what was there, what stayed, and what went: observations without depth, those too far
    from their landmark, and landmarks."""
    rows = landmarks.select("landmark_id", F.lit(1).alias("l"), F.lit(0).alias("n"), F.lit(0).alias("k"))
    rows = rows.unionAll(checked.select("landmark_id", F.lit(0), F.lit(1), F.col("keep").cast("int")))
    by = rows.groupBy("landmark_id").agg(*[F.sum(c).alias(c) for c in "lnk"])
    stays = F.col("k") >= MIN_OBSERVATIONS
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = {
        "with_depth": total("n"), "kept": total(F.when(stays, F.col("k"))), "landmarks": total("l"), "landmarks_kept": F.count(F.when(stays, 1)),
        "removed_outliers": total(F.col("n") - F.col("k")), "removed_landmarks": total(F.when(~stays, F.col("l"))),
    }
    deep = {"observations": F.count("*"), "removed_without_depth": F.count(F.when(~F.coalesce(F.col(depth) > 0, F.lit(False)), 1))}
    named = lambda df, s: df.agg(*[v.alias(c) for c, v in s.items()]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in s])))
    return named(by, sums).unionAll(named(observations, deep))


def counters(*groups: dict[str, DataFrame]) -> DataFrame:
    """(metric, value) of row counts."""
    rows = [df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value") for g in groups for name, df in g.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out
