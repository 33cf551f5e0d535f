"""Multi-view tracks: components of the match graph, one keypoint of each camera."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .ranking import row_numbers

SHIFT = 1 << 32


def node(camera: str, keypoint: str):
    """A keypoint as one ordered number."""
    return F.col(camera).cast("long") * SHIFT + F.col(keypoint).cast("long")


def edges(matches: DataFrame) -> DataFrame:
    """(a, b) of the matches; only inliers where matches have that column."""
    kept = matches.where("inlier") if "inlier" in matches.columns else matches
    return kept.select(node("camera_1", "kp_1").alias("a"), node("camera_2", "kp_2").alias("b"))


def components(matches: DataFrame) -> DataFrame:
    """(camera_id, kp_idx, component): the least node of each component names it."""
    return of_nodes(connected_components(edges(matches)))


def of_nodes(found: DataFrame) -> DataFrame:
    """(camera_id, kp_idx, component) of labelled nodes."""
    return found.select(F.floor(F.col("node") / SHIFT).cast("int").alias("camera_id"), F.pmod("node", F.lit(SHIFT)).cast("int").alias("kp_idx"), "component")


def observations(nodes: DataFrame, keypoints: DataFrame) -> DataFrame:
    """(landmark_id, component, camera_id, kp_idx, px, py) of tracks with two cameras or more.

    Only keypoints that exist count; of several of one camera the least stays. Ids ascend from 0 with the components.
    """
    real = nodes.join(keypoints.select("camera_id", "kp_idx"), ["camera_id", "kp_idx"], "left_semi")
    one = real.groupBy("component", "camera_id").agg(F.min("kp_idx").alias("kp_idx"))
    seen = one.groupBy("component").agg(F.count("*").alias("n")).where("n >= 2")
    ids = row_numbers(seen.select("component"), ["component"]).select("component", (F.col("row") - 1).cast("int").alias("landmark_id"))
    pixels = keypoints.select("camera_id", "kp_idx", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    return one.join(ids, "component").join(pixels, ["camera_id", "kp_idx"]).select("landmark_id", "component", "camera_id", "kp_idx", "px", "py")


def length_histogram(obs: DataFrame) -> DataFrame:
    """(length, n_tracks, share) of tracks by their number of observations."""
    lengths = obs.groupBy("landmark_id").agg(F.count("*").alias("length")).groupBy("length").agg(F.count("*").alias("n_tracks"))
    return lengths.crossJoin(F.broadcast(lengths.agg(F.sum("n_tracks").alias("__all")))).select("length", "n_tracks", (F.col("n_tracks") / F.col("__all")).alias("share"))


def length_stats(obs: DataFrame) -> DataFrame:
    """(metric, value): tracks, observations, the mean length, and the share of tracks of three observations or more."""
    lengths = obs.groupBy("landmark_id").agg(F.count("*").alias("length"))
    sums = lengths.agg(F.count("*").cast("double").alias("tracks"), F.sum("length").cast("double").alias("observations"), F.avg("length").alias("mean_length"), F.avg((F.col("length") >= 3).cast("double")).alias("share_of_three"))
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in sums.columns])))
