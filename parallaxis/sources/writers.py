"""Sinks: camera and trajectory text files, the landmark cache, and metrics. Camera-sized outputs are one file."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

#: fixed value: the header of an images file
HEADER = "# IMAGE_ID, QW, QX, QY, QZ, TX, TY, TZ, CAMERA_ID, IMAGE_NAME"


def _number(c) -> F.Column:
    return c.cast("string")


def image_lines(frames: DataFrame, pose: str = "optimized_pose") -> DataFrame:
    """(camera_id, value): the line of each camera, world to camera, in full precision."""
    p = F.col(pose)
    return frames.select("camera_id", F.concat_ws(" ", (F.col("camera_id") + 1).cast("string"), *[_number(p[c]) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")], F.lit("1"), "name").alias("value"))


def trajectory_rows(frames: DataFrame, pose: str) -> DataFrame:
    """(ts, tx .. qw): camera to world."""
    p = G.let(F.col(pose), G.inverse)
    return frames.select("camera_id", "ts", p.alias("p")).select("camera_id", "ts", *[F.col(f"p.{c}") for c in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")])


def trajectory_lines(frames: DataFrame, pose: str) -> DataFrame:
    rows = trajectory_rows(frames, pose)
    return rows.select("camera_id", F.concat_ws(" ", *[_number(F.col(c)) for c in ("ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw")]).alias("value"))


def _write(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).sortWithinPartitions("camera_id").select("value").write.mode("overwrite").text(path)


def write_images(frames: DataFrame, path: str, pose: str = "optimized_pose") -> None:
    """A header, then each camera's line and an empty one, in the order of ids."""
    lines = image_lines(frames, pose)
    head = frames.sparkSession.createDataFrame([(-1, HEADER)], "camera_id int, value string")
    _write(head.unionByName(lines.withColumn("value", F.concat("value", F.lit("\n")))), path)


def write_trajectory(frames: DataFrame, path: str, pose: str = "optimized_pose") -> None:
    _write(trajectory_lines(frames, pose), path)


def write_landmarks(landmarks: DataFrame, observations: DataFrame, path: str, fingerprint: str = "") -> None:
    """Both tables as Parquet, with what they were made from, so a stale cache is noticed."""
    landmarks.withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite").parquet(f"{path}/landmarks")
    observations.write.mode("overwrite").parquet(f"{path}/observations")


def read_landmarks(spark, path: str, fingerprint: str = "") -> tuple[DataFrame, DataFrame] | None:
    """The tables, or None if there are none or they were made from something else."""
    try:
        landmarks = spark.read.parquet(f"{path}/landmarks")
    except Exception as e:  # Spark's own exception for a path that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    if landmarks.where(F.col("fingerprint") != fingerprint).limit(1).count():
        return None
    return landmarks.drop("fingerprint"), spark.read.parquet(f"{path}/observations")


def cache_bytes(landmarks: list[tuple], observations: dict[int, list[tuple]]) -> bytes:
    """The binary cache format, for exchange: landmarks (id, optimized, six coordinates), observations by id."""
    out = [struct.pack("<q", len(landmarks))]
    for ident, done, *position in landmarks:
        out.append(struct.pack("<ib6d", ident, done, *position))
        own = observations.get(ident, [])
        out.append(struct.pack("<q", len(own)))
        out += [struct.pack("<iiddddb", *o) for o in own]
    return b"".join(out)
