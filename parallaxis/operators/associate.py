"""Interpolating as-of join between two sensor streams, scaled by time buckets.

Rows of both streams are cut into buckets of time, so a window never holds more than one bucket of one key; what a
bucket needs from others is the last keyframe before it and the first behind it, carried over a table of one row per
bucket. No range join and no window over a whole stream is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G

OFFSET = 0.4  # seconds that a frame is stamped late
BUCKET = 60.0


def neighbours(frames: DataFrame, keyframes: DataFrame, by: list[str] | None = None, offset: float = OFFSET, bucket: float = BUCKET) -> DataFrame:
    """Frames with `at` (their time less the offset), `prev` (the last keyframe strictly before) and `next` (the first
    at or after), structs of the keyframe's columns or null. frames and keyframes: ts DOUBLE seconds, and the keys `by`.

    Ties between keyframes go by the order of their other columns. A frame of a null time has no neighbours.
    """
    by = by or []
    key_columns = [c for c in keyframes.columns if c not in by]
    frame_columns = [c for c in frames.columns if c not in by]
    key_row = F.struct(*[F.col(c) for c in ("ts", *[c for c in key_columns if c != "ts"])])
    left = frames.select(*by, (F.col("ts") - F.lit(offset)).alias("at"), F.lit(0).alias("kind"), F.struct(*[F.col(c) for c in frame_columns]).alias("frame"))
    right = keyframes.where("ts is not null").select(*by, F.col("ts").alias("at"), F.lit(1).alias("kind"), key_row.alias("key"))
    rows = left.unionByName(right, allowMissingColumns=True).withColumn("bucket", F.floor(F.col("at") / bucket))
    # a frame stands before a keyframe of the same time: that one is its next
    own = Window.partitionBy(*by, "bucket").orderBy("at", "kind", "key")
    near = rows.withColumn("prev", F.last("key", True).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.first("key", True).over(own.rowsBetween(0, Window.unboundedFollowing)))
    ends = rows.groupBy(*by, "bucket").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    along = Window.partitionBy(*by).orderBy("bucket")
    carried = ends.withColumn("before", F.last("last", True).over(along.rowsBetween(Window.unboundedPreceding, -1))).withColumn("behind", F.first("first", True).over(along.rowsBetween(1, Window.unboundedFollowing)))
    names = [*by, "bucket"]
    other = carried.select(*[F.col(c).alias(f"__{c}") for c in names], "before", "behind")
    met = near.where("kind = 0").join(other, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names])
    known = F.col("at").isNotNull()
    return met.select(*by, "frame.*", "at", F.when(known, F.coalesce("prev", "before")).alias("prev"), F.when(known, F.coalesce("next", "behind")).alias("next"))


def weighted(pairs: DataFrame) -> DataFrame:
    """Adds `alpha` and `branch`: clamp_first without a keyframe before, clamp_last without one behind, else between."""
    gap = F.col("next.ts") - F.col("prev.ts")
    alpha = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("at") - F.col("prev.ts"), gap)))
    branch = F.when(F.col("prev").isNull() & F.col("next").isNull(), None).when(F.col("prev").isNull(), "clamp_first").when(F.col("next").isNull(), "clamp_last").otherwise("between")
    return pairs.withColumn("branch", branch).withColumn("alpha", F.when(branch == "between", alpha))


def interpolate_value(pairs: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the value of a frame: linear between neighbours, theirs beyond the ends."""
    p, n, a = F.col(f"prev.{value}"), F.col(f"next.{value}"), F.col("alpha")
    return weighted(pairs).withColumn(out, F.when(F.col("branch") == "between", (1 - a) * p + a * n).otherwise(F.coalesce(p, n)))


def associate(frames: DataFrame, keyframes: DataFrame, camera_lidar, offset: float = OFFSET, bucket: float = BUCKET) -> DataFrame:
    """Frames with matched_lidar_id and initial_pose (world to camera).

    keyframes: (lidar_id, ts, pose of LiDAR in the world); camera_lidar: the pose of LiDAR in the camera, a Column.
    matched_lidar_id is the keyframe strictly before, not the nearest, except before the first one. An empty keyframe
    table is an error.
    """
    if not keyframes.limit(1).count():
        raise ValueError("no keyframes to associate with")
    met = weighted(neighbours(frames, keyframes.select("ts", "lidar_id", "pose"), None, offset, bucket))
    between = F.col("branch") == "between"
    blended = F.when(between, G.blend(F.col("prev.pose"), F.col("next.pose"), F.col("alpha"))).otherwise(F.coalesce("prev.pose", "next.pose"))
    placed = met.withColumn("__pose", blended)
    return placed.withColumn("matched_lidar_id", F.coalesce("prev.lidar_id", "next.lidar_id")).withColumn("initial_pose", F.when(F.col("__pose").isNotNull(), G.let(F.col("__pose"), lambda p: G.let(G.inverse(p), lambda i: G.compose(camera_lidar, i))))).drop("prev", "next", "at", "alpha", "branch", "__pose")
