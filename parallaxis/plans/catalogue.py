"""The query catalogue: every operator over analogue views of the driver's tables, with its DuckDB equivalent.

Keypoints come from `embeddings` (a label is a camera), points from `lineitem` (a supplier is a LiDAR scan), frames and
keyframes from `events` (clicks and views of a user).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..operators import associate, averages, components, matching, solver, splines, tracks, trajectory, triangulate, zbuffer
from .scene import start_poses, start_sql, table_poses

GRID = G.Intrinsics(50.0, 50.0, 32.0, 24.0, 64, 48)
WIDE = G.Intrinsics(500.0, 500.0, 320.0, 240.0, 640, 480)
RATIO, PAIR_WINDOW = 0.95, 5
#: a distance that stands for the epipolar test, and the least inliers of a pair: both sides of each have rows
INLIER, LEAST_INLIERS = 1.155, 5
#: pixels of the epipolar test, and the share of inliers down to which a pair's matrix is searched for
EPIPOLAR, LEAST_SHARE = 20.0, 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- views ------------------------------------------------------------------------------------------------------------


def points(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("int").alias("lidar_id"), ((F.col("l_quantity") - 25.5) / 10).alias("x"), ((F.col("l_discount") - 0.05) * 20).alias("y"), (F.col("l_extendedprice") / 20000 - 1).alias("z")
    )


def keypoints(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    return e.select(
        F.col("label").alias("camera_id"), (F.row_number().over(w) - 1).alias("kp_idx"), F.col("embedding").alias("descriptor"),
        (320 + 400 * F.col("embedding")[0].cast("double")).alias("x"), (240 + 400 * F.col("embedding")[1].cast("double")).alias("y"),
    )


def stream(spark, d, kind: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, d, "events").where(F.col("event_type") == kind).select("user_id", "event_id", seconds.alias("ts"), "value")


def cameras(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("camera_id")).distinct().withColumn("has_descriptors", F.lit(True))


def ratio_matches(spark, d) -> DataFrame:
    return matching.ratio_test(matching.knn(keypoints(spark, d).select("camera_id", "kp_idx", "descriptor"), matching.sequential_pairs(cameras(spark, d), PAIR_WINDOW)), RATIO, single=False)


def observations(spark, d) -> DataFrame:
    k = keypoints(spark, d)
    return tracks.observations(tracks.components(ratio_matches(spark, d)), k)


def poses(spark, d) -> DataFrame:
    """A pose per event: rotation about a tilted axis by the value, translation from user and value."""
    e = table(spark, d, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    v = F.col("value")
    p = G.pose(F.sin(v / 100), F.cos(v / 70) / 2, v / 200, F.lit(1.5), F.col("user_id") / 10, v / 25, (F.col("event_id") % 17).cast("double"))
    return e.select("event_id", "user_id", seconds.alias("ts"), "value", p.alias("pose"))


def _flat(p, prefix: str = "", digits: int = 6) -> list:
    return [F.round(p[c], digits).alias(f"{prefix}{c}") for c in ("qx", "qy", "qz", "qw", "tx", "ty", "tz")]


# --- queries ----------------------------------------------------------------------------------------------------------


def zbuffer_min_depth(spark, d):
    p = points(spark, d).withColumn("camera_id", (F.col("lidar_id") % 10).cast("int"))
    return zbuffer.nearest(zbuffer.visible(p, GRID, F.struct("x", "y", "z"))).withColumn("depth", F.col("depth").cast("double"))


def zbuffer_accumulate(spark, d):
    p = points(spark, d).withColumn("camera_id", (F.col("lidar_id") % 10).cast("int"))
    first = zbuffer.nearest(zbuffer.visible(p, GRID, F.struct("x", "y", "z")))
    second = zbuffer.nearest(zbuffer.visible(p, GRID, G.vec(F.col("x") + 0.25, F.col("y"), F.col("z") - 0.125)))
    return zbuffer.accumulate(first, second).withColumn("depth", F.col("depth").cast("double"))


def cull_counts(spark, d):
    p = points(spark, d)
    seen = zbuffer.visible(p, WIDE, F.struct("x", "y", "z"))
    return triangulate.counters({"points": p, "in_front": p.where("z > 0"), "in_image": seen, "cells": seen.select("lidar_id", "v", "u").distinct()})


def asof_interpolate(spark, d):
    met = associate.interpolate_value(associate.neighbours(stream(spark, d, "click"), stream(spark, d, "view"), ["user_id"]), "value", "interpolated")
    return met.select("event_id", "user_id", "branch", F.round("interpolated", 6).alias("interpolated"))


def asof_matched_id(spark, d):
    met = associate.neighbours(stream(spark, d, "click"), stream(spark, d, "view"), ["user_id"])
    return met.select("event_id", F.coalesce("prev.event_id", "next.event_id").alias("matched_id"))


def asof_pose(spark, d):
    """Pose association: the later keyframe decides with an earlier one, by line and arc."""
    p = poses(spark, d)
    frames = stream(spark, d, "click").select("user_id", "event_id", "ts")
    keys = p.join(table(spark, d, "events").where("event_type = 'view'").select("event_id"), "event_id", "left_semi").select("user_id", "ts", "event_id", "pose")
    met = associate.weighted(associate.neighbours(frames, keys, ["user_id"])).where("branch = 'between'")
    return met.select("event_id", G.blend(F.col("prev.pose"), F.col("next.pose"), F.col("alpha")).alias("p")).select("event_id", *[F.round(F.col(f"p.{c}"), 5).alias(c) for c in ("qx", "qy", "qz", "qw", "tx", "ty", "tz")])


def _frames(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("camera_id"), (F.col("c_custkey") % 97).cast("int").alias("matched_lidar_id"))


def lidar_window_join(spark, d):
    scans = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("lidar_id"))
    return zbuffer.lidar_window(_frames(spark, d)).join(scans, "lidar_id").select("camera_id", "lidar_id")


def required_ids_distinct(spark, d):
    return zbuffer.required_ids(_frames(spark, d))


def pairs_sequential(spark, d):
    return matching.sequential_pairs(cameras(spark, d), PAIR_WINDOW)


def pairs_exhaustive(spark, d):
    return matching.exhaustive_pairs(cameras(spark, d))


def knn2_l2(spark, d):
    k = keypoints(spark, d).select("camera_id", "kp_idx", "descriptor")
    return matching.knn(k, matching.sequential_pairs(cameras(spark, d), 2)).withColumn("distance", F.round("distance", 6))


def lowe_ratio(spark, d):
    return ratio_matches(spark, d).withColumn("distance", F.round("distance", 6))


def _neighbours(spark, d):
    return matching.knn(keypoints(spark, d).select("camera_id", "kp_idx", "descriptor"), matching.sequential_pairs(cameras(spark, d), PAIR_WINDOW))


def lowe_ratio_single(spark, d):
    """The ratio test in single precision."""
    return matching.ratio_test(_neighbours(spark, d), RATIO).select("camera_1", "camera_2", "kp_1", "kp_2")


def lowe_ratio_capped(spark, d):
    """The ratio test with a greatest distance."""
    return matching.ratio_test(_neighbours(spark, d), RATIO, 1.05, single=False).withColumn("distance", F.round("distance", 6))


def inlier_gate(spark, d):
    """Matches of the pairs with enough inliers, by a distance that stands for the epipolar test."""
    judged = ratio_matches(spark, d).withColumn("inlier", F.col("distance") < INLIER)
    return matching.gate(judged, LEAST_INLIERS, inliers=True).select("camera_1", "camera_2", "kp_1", "kp_2", "inlier")


def inlier_components(spark, d):
    """Components of inlier matches only."""
    return tracks.components(ratio_matches(spark, d).withColumn("inlier", F.col("distance") < INLIER))


def pair_stats(spark, d):
    return matching.pair_stats(ratio_matches(spark, d).withColumn("inlier", F.col("distance") < INLIER)).withColumn("share", F.round("share", 9))


def pair_gate(spark, d):
    return matching.gate(ratio_matches(spark, d), 8).select("camera_1", "camera_2", "kp_1", "kp_2")


def match_pixels(spark, d):
    k = keypoints(spark, d).select("camera_id", "kp_idx", "x", "y")
    return matching.match_pixels(ratio_matches(spark, d), k).select("camera_1", "camera_2", "kp_1", "kp_2", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


def low_inlier_pairs(spark, d):
    return matching.low_inlier_pairs(ratio_matches(spark, d).withColumn("inlier", F.col("distance") < INLIER), 0.5)


def connected_components(spark, d):
    return tracks.components(ratio_matches(spark, d))


def components_in_batches(spark, d):
    """Components of the match graph, whose matches arrive in three batches: of neighbours first, then of wider steps."""
    from ..operators.components import Scratch
    from .growing import GrowingComponents

    own = Scratch(spark)
    place = cameras(spark, d).select("camera_id", F.row_number().over(Window.orderBy("camera_id")).alias("pos"))
    sides = [place.select(F.col("camera_id").alias(f"camera_{n}"), F.col("pos").alias(f"pos_{n}")) for n in (1, 2)]
    stepped = own.keep(ratio_matches(spark, d).join(F.broadcast(sides[0]), "camera_1").join(F.broadcast(sides[1]), "camera_2").withColumn("batch", F.expr("(pos_2 - pos_1) div 2")))
    growing = GrowingComponents(spark, f"{own.folder}/growing")
    for batch in range(PAIR_WINDOW // 2 + 1):
        growing.add(tracks.edges(stepped.where(F.col("batch") == batch)), batch)
    own.drop(stepped)
    return tracks.of_nodes(growing.labels())


def track_observations(spark, d):
    return observations(spark, d).select("landmark_id", "component", "camera_id", "kp_idx", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


def track_length_stats(spark, d):
    return tracks.length_stats(observations(spark, d)).withColumn("value", F.round("value", 6))


def track_length_hist(spark, d):
    return tracks.length_histogram(observations(spark, d)).withColumn("share", F.round("share", 9))


def _ordered(spark, d, key: str) -> DataFrame:
    """Links (a, b) of customers and a key of the lines of their orders, one for each line; keys are numbered from 10**9 on."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    i = table(spark, d, "lineitem").select("l_orderkey", key)
    return o.join(i, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), (F.col(key) + 1000000000).alias("b"))


def customer_components(spark, d):
    """Components of the graph of all customers and the parts in all their orders."""
    return components.connected_components(_ordered(spark, d, "l_partkey"))


def customer_components_whole(spark, d):
    """Components of the graph of all customers and suppliers, linked by every line of every order."""
    return components.connected_components(_ordered(spark, d, "l_suppkey"))


def line_chain_components(spark, d):
    """Long chains: each line's supplier stands beside its part, and parts beside each other by ten numbers."""
    i = table(spark, d, "lineitem").select((F.col("l_suppkey") + 1000000000).alias("a"), F.col("l_partkey").alias("b"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 10).alias("b"))
    return components.connected_components(i.unionByName(p))


def _observed(spark, d):
    """Observations of a camera per supplier group at pixels on the grid, two thirds with an old depth."""
    p = points(spark, d).withColumn("camera_id", (F.col("lidar_id") % 10).cast("int"))
    u, v = (GRID.fx * F.col("x") / 2 + GRID.cx), (GRID.fy * F.col("y") / 2 + GRID.cy)
    keyed = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 10).cast("int").alias("camera_id"), ((F.col("l_quantity") - 25.5) / 10).alias("x"), ((F.col("l_discount") - 0.05) * 20).alias("y"))
    obs = keyed.select(F.col("l_orderkey").alias("landmark_id"), F.col("l_linenumber").alias("kp_idx"), "camera_id", u.alias("px"), v.alias("py"), F.when(F.col("l_orderkey") % 3 > 0, (F.col("l_linenumber") + 0.5)).alias("depth"))
    return obs, zbuffer.nearest(zbuffer.visible(p, GRID, F.struct("x", "y", "z")))


def depth_lookup(spark, d):
    obs, cells = _observed(spark, d)
    return zbuffer.observation_depth(obs, cells, GRID).select("landmark_id", "kp_idx", "camera_id", "depth")


def min_support(spark, d):
    obs, cells = _observed(spark, d)
    kept = triangulate.supported(triangulate.with_depth(zbuffer.observation_depth(obs, cells, GRID)))
    return kept.groupBy("landmark_id").agg(F.count("*").alias("n_observations"))


def backproject(spark, d):
    obs, _ = _observed(spark, d)
    p = G.back_project(GRID, F.col("px"), F.col("py"), F.col("depth"))
    return obs.where("depth is not null").select("landmark_id", "kp_idx", F.round(p.x, 6).alias("x"), F.round(p.y, 6).alias("y"), F.round(p.z, 6).alias("z"))


def reproject_filter(spark, d):
    obs, _ = _observed(spark, d)
    pose = G.pose(0.0, 0.6, 0.0, 0.8, 0.05, 0.0, 0.1, normalize=False)
    position = G.vec((F.col("landmark_id") % 11 - 5) / 10, (F.col("landmark_id") % 7 - 3) / 10, F.col("landmark_id") % 5 + 0.5)
    checked = triangulate.reprojection(obs, position, pose, GRID).where("error <= 40")
    return checked.select("landmark_id", "kp_idx", F.round("error", 5).alias("error"))


def geometric_median(spark, d):
    return triangulate.medians(points(spark, d).where("z > 0"), "lidar_id").select("lidar_id", *[F.round(F.col(f"m.{c}"), 5).alias(c) for c in "xyz"])


def _cameras(spark, d) -> DataFrame:
    """A pose for each of ten cameras, from the first nations: small turns about y, and steps along x."""
    n = table(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").cast("int").alias("camera_id"))
    i = F.col("camera_id")
    return n.select("camera_id", G.pose(0.0, i / 100, 0.0, 1.0, i / 20, 0.0, 0.1).alias("pose"))


def _triangulated(spark, d):
    obs, cells = _observed(spark, d)
    seen = zbuffer.observation_depth(obs, cells, GRID)
    return triangulate.triangulate(seen.select("landmark_id").distinct(), seen, _cameras(spark, d), GRID, 12.0)


def triangulated_landmarks(spark, d):
    out, _, _ = _triangulated(spark, d)
    return out.select("landmark_id", *[F.round(F.col(f"initial_position.{c}"), 4).alias(c) for c in "xyz"])


def triangulated_observations(spark, d):
    _, kept, _ = _triangulated(spark, d)
    return kept.select("landmark_id", "camera_id", "kp_idx")


def triangulation_metrics(spark, d):
    return _triangulated(spark, d)[2]


def observation_cameras(spark, d):
    """Observations with their camera's pose; those of unknown cameras stay, without one."""
    obs, _ = _observed(spark, d)
    odd = obs.withColumn("camera_id", F.when(F.col("kp_idx") == 7, F.col("camera_id") + 100).otherwise(F.col("camera_id")).cast("int"))
    return triangulate.observation_poses(odd, _cameras(spark, d)).select("landmark_id", "kp_idx", "camera_id", F.round("pose.tx", 6).alias("tx"), F.round("pose.qy", 6).alias("qy"))


def depth_maps(spark, d):
    """The whole z-buffer: frames from nations, keyframes from suppliers, points from lines; poses are composed per pair."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("camera_id"), (F.col("n_nationkey") * 4).cast("int").alias("matched_lidar_id"))
    i = F.col("camera_id")
    frames = n.withColumn("initial_pose", G.pose(0.0, i / 200, 0.0, 1.0, i / 50, 0.0, 0.2))
    s = F.col("s_suppkey")
    keys = table(spark, d, "supplier").select(s.cast("int").alias("lidar_id"), G.pose(0.0, 0.0, (s % 7) / 100, 1.0, (s % 5) / 10, 0.0, 0.0).alias("pose"))
    return zbuffer.depth_maps(frames, keys, zbuffer.blocks(points(spark, d)), GRID).withColumn("depth", F.round(F.col("depth").cast("double"), 5))


def _path(spark, d, user: int):
    p = poses(spark, d).where(F.col("user_id") == user).select("ts", *[F.col(f"pose.{c}").alias(c) for c in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")])
    return p


def trajectory_rmse(spark, d):
    """Each user's path against the same path, moved by half and drifting by time."""
    p = trajectory.numbered(poses(spark, d).select("user_id", "ts", "pose.*"), ["user_id"])
    drifted = p.withColumns({"tx": F.col("tx") + F.col("row") * 0.01, "ty": F.col("ty") + 0.5})
    return trajectory.rmse(p, drifted, ["user_id"]).withColumn("rmse", F.round("rmse", 6))


def trajectory_pair_rmse(spark, d):
    a = poses(spark, d).where("event_id % 2 = 0").select("ts", "pose.*")
    b = poses(spark, d).where("event_id % 2 = 1").select("ts", "pose.*")
    return trajectory.rmse(a, b).withColumn("rmse", F.round("rmse", 6))


def trajectory_heading(spark, d):
    return trajectory.with_heading(poses(spark, d).select("event_id", "pose.*")).select("event_id", *[F.round(c, 6).alias(c) for c in ("hx", "hy", "hz")])


def align_start(spark, d):
    p = poses(spark, d).select("event_id", "user_id", "ts", "pose.*")
    return trajectory.align_start(p, ["user_id"]).select("event_id", *[F.round(c, 6).alias(c) for c in ("tx", "ty", "tz")])


def _pose_pairs(spark, d):
    p = poses(spark, d)
    q = p.select((F.col("event_id") + 1).alias("event_id"), F.col("pose").alias("other"))
    return p.join(q, "event_id")


def slerp(spark, d):
    s = G.slerp(F.col("pose"), F.col("other"), F.lit(0.25))
    return _pose_pairs(spark, d).select("event_id", *[F.round(s[c], 5).alias(c) for c in ("qx", "qy", "qz", "qw")])


def se3_compose(spark, d):
    return _pose_pairs(spark, d).select("event_id", G.compose(F.col("pose"), F.col("other")).alias("p")).select("event_id", *_flat(F.col("p")))


def se3_inverse(spark, d):
    return poses(spark, d).select("event_id", G.inverse(F.col("pose")).alias("p")).select("event_id", *_flat(F.col("p")))


def se3_act(spark, d):
    a = G.act(F.col("pose"), G.vec(1.0, -2.0, 0.5))
    return poses(spark, d).select("event_id", *[F.round(a[c], 6).alias(c) for c in "xyz"])


def se3_log(spark, d):
    turned = poses(spark, d).select("event_id", "pose", G.rotation_log(F.col("pose")).alias("w"))
    t = G.pose_log(F.col("pose"), F.col("w"))
    return turned.select("event_id", *[F.round(t[c], 5).alias(c) for c in ("ux", "uy", "uz", "wx", "wy", "wz")])


def se3_exp(spark, d):
    p = G.pose_exp(F.col("user_id") / 50, F.col("value") / 100, F.lit(0.3), F.sin("value"), F.col("value") / 90, F.lit(0.2))
    return table(spark, d, "events").select("event_id", p.alias("p")).select("event_id", *_flat(F.col("p"), digits=5))


def axis_angles(spark, d):
    return poses(spark, d).select("event_id", *[F.round(G.axis_angle(F.col("pose"), a), 5).alias(f"angle_{a}") for a in "xyz"])


def robust_cost_breakdown(spark, d):
    """The mean cost of each kind of residual block over the observations of the table scene, at its disturbed start."""
    from .scene import table_residuals

    blocks = table_residuals(table(spark, d, "orders"), table(spark, d, "lineitem"))
    counts = blocks.groupBy("block_type").agg(F.count("*").alias("blocks"))
    return solver.cost_breakdown(blocks).join(counts, "block_type").select("block_type", "blocks", F.round(F.col("cost") / F.col("blocks"), 5).alias("cost"))


def observation_residuals(spark, d):
    """Squared residuals of each observation of the table scene at its disturbed start."""
    from .scene import table_residuals

    blocks = table_residuals(table(spark, d, "orders"), table(spark, d, "lineitem"))
    return blocks.where("block_type <> 'prior'").withColumn("square", F.round("square", 4))


def ba_solve(spark, d):
    """Refines the poses of ten cameras and a landmark for each order from the lines' observations; see `plans.scene`."""
    from .scene import solved_tables

    return solved_tables(table(spark, d, "orders"), table(spark, d, "lineitem"))


def ba_alternation(spark, d):
    """The whole alternation over orders and lines: refinement, depth rendered from a cloud, triangulation."""
    from .scene import alternated_tables

    return alternated_tables(table(spark, d, "orders"), table(spark, d, "lineitem"))


def spline_positions(spark, d):
    """A spline through each user's positions at every event, read off at three times, with its derivatives."""
    p = trajectory.numbered(poses(spark, d).select("user_id", "ts", "pose.*"), ["user_id"])
    controls = p.select("user_id", (F.col("row") - 1).alias("i"), F.array("tx", "ty", "tz").alias("params"))
    times = table(spark, d, "events").select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(x) for x in (0.0, 1.3, 4.75)])).alias("t"))
    out = splines.evaluate(times, controls, "r3", 0.0, 0.5, ["user_id"])
    # a matrix's last column holds the translation
    return out.select("user_id", "t", *[F.round(F.col("value")[i], 6).alias(f"p{i}") for i in range(3)], *[F.round(F.col(name)[4 * i + 3], 5).alias(f"{short}{i}") for name, short in (("first", "v"), ("second", "a")) for i in range(3)])


def mean_positions(spark, d):
    p = poses(spark, d).select("user_id", F.array("pose.tx", "pose.ty", "pose.tz").alias("params"))
    return averages.average(p, "r3", ["user_id"]).select("user_id", *[F.round(F.col("params")[i], 6).alias(c) for i, c in enumerate(("x", "y", "z"))])


def mean_turns(spark, d):
    """The mean rotation of each user's events in the plane, all within a quarter turn."""
    angle = F.col("value") / 1000
    p = table(spark, d, "events").select("user_id", F.array(F.cos(angle), F.sin(angle)).alias("params"))
    m = averages.average(p, "so2", ["user_id"])
    return m.select("user_id", F.round(F.atan2(F.col("params")[1], F.col("params")[0]), 6).alias("angle"))


def keyframes_from_text(spark, d):
    """Each view as a keyframe's JSON object of several lines, written as text, scanned by splits and parsed again."""
    from ..operators.components import Scratch
    from ..sources import readers

    p = poses(spark, d).join(table(spark, d, "events").where("event_type = 'view'").select("event_id"), "event_id", "left_semi")
    own = F.struct(
        F.col("event_id").alias("key_frame_id"), F.col("ts").alias("timestamp"), F.format_string("./{%d}.ply", "event_id").alias("saved_frame_path"),
        F.struct(F.array("pose.qx", "pose.qy", "pose.qz", "pose.qw").alias("quaternion_xyzw"), F.array("pose.tx", "pose.ty", "pose.tz").alias("translation")).alias("lio_pose"),
    )
    path = f"{Scratch(spark).folder}/keyframes"
    p.select(F.to_json(own, {"pretty": "true"})).write.text(path)
    return readers.keyframes(spark, path, "clouds").select("lidar_id", "ply_path", F.round("ts", 3).alias("ts"), *_flat(F.col("pose")))


def verified_matches(spark, d):
    """Matches of pairs with enough of them, and whether they fit their pair's epipolar geometry."""
    k = keypoints(spark, d)
    m = matching.gate(matching.match_pixels(ratio_matches(spark, d), k.select("camera_id", "kp_idx", "x", "y")), 8)
    return matching.verify_geometry(m, EPIPOLAR, least_share=LEAST_SHARE).select("camera_1", "camera_2", "kp_1", "kp_2", "inlier")


# --- DuckDB -----------------------------------------------------------------------------------------------------------

_POINTS = "points AS (SELECT CAST(l_suppkey AS INT) AS lidar_id, (l_quantity - 25.5::DOUBLE) / 10 AS x, (l_discount - 0.05::DOUBLE) * 20 AS y, l_extendedprice / 20000 - 1 AS z FROM lineitem)"
_SEEN = "seen AS (SELECT CAST(lidar_id % 10 AS INT) AS camera_id, round(50::DOUBLE * x / z + 32) AS u, round(50::DOUBLE * y / z + 24) AS v, CAST(z AS FLOAT) AS depth FROM points WHERE z > 0)"
_CELLS = "cells AS (SELECT camera_id, CAST(v AS INT) AS v, CAST(u AS INT) AS u, CAST(min(depth) AS DOUBLE) AS depth FROM seen WHERE u >= 0 AND u < 64 AND v >= 0 AND v < 48 GROUP BY ALL)"
_KEYS = "kps AS (SELECT label AS camera_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS kp_idx, CAST(embedding AS DOUBLE[]) AS e, 320 + 400 * CAST(embedding[1] AS DOUBLE) AS x, 240 + 400 * CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
_CAMS = "cams AS (SELECT camera_id, row_number() OVER (ORDER BY camera_id) AS pos FROM (SELECT DISTINCT label AS camera_id FROM embeddings))"


def _components(nodes_and_links: str) -> str:
    """SQL for the least node that each node of `links` (a, b) reaches; labels are kept once per node and only fall."""
    return f"""WITH RECURSIVE {nodes_and_links}, sides AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
      cc(node, component) USING KEY (node) AS (
        SELECT DISTINCT a, a FROM sides
        UNION
        SELECT u.node, min(v.component) FROM cc v JOIN sides ON sides.b = v.node JOIN recurring.cc u ON u.node = sides.a WHERE v.component < u.component GROUP BY u.node)
      SELECT node, component FROM cc"""


def _median(points: str) -> str:
    """SQL for Weiszfeld's iteration over `points` (id, x, y, z): CTEs that end in `medians` (id, x, y, z)."""
    return f"""{points}, weis(id, n, x, y, z, moving) AS (
        SELECT id, 0, avg(x), avg(y), avg(z), count(*) > 1 FROM points GROUP BY id
        UNION ALL
        SELECT id, n + 1, sx, sy, sz, sqrt((sx - mx) * (sx - mx) + (sy - my) * (sy - my) + (sz - mz) * (sz - mz)) >= 1e-6::DOUBLE FROM (
          SELECT w.id, any_value(w.n) AS n, any_value(w.x) AS mx, any_value(w.y) AS my, any_value(w.z) AS mz, sum(p.x / d) / sum(1 / d) AS sx, sum(p.y / d) / sum(1 / d) AS sy, sum(p.z / d) / sum(1 / d) AS sz
          FROM weis w JOIN (SELECT id AS pid, x, y, z FROM points) p ON p.pid = w.id, LATERAL (SELECT sqrt((p.x - w.x) * (p.x - w.x) + (p.y - w.y) * (p.y - w.y) + (p.z - w.z) * (p.z - w.z)) AS d)
          WHERE w.moving AND w.n < 50 AND d >= 1e-9::DOUBLE GROUP BY w.id HAVING sum(1 / d) >= 1e-9::DOUBLE)),
      medians AS (SELECT id, arg_max(x, n) AS x, arg_max(y, n) AS y, arg_max(z, n) AS z FROM weis GROUP BY id)"""


def _knn(window: int) -> str:
    return f"""{_KEYS}, {_CAMS}, pairs AS (SELECT a.camera_id AS camera_1, b.camera_id AS camera_2 FROM cams a JOIN cams b ON b.pos > a.pos AND b.pos <= a.pos + {window}),
    dist AS (SELECT camera_1, camera_2, a.kp_idx AS kp_1, b.kp_idx AS kp_2, array_distance(CAST(a.e AS DOUBLE[64]), CAST(b.e AS DOUBLE[64])) AS distance
      FROM pairs JOIN kps a ON a.camera_id = camera_1 JOIN kps b ON b.camera_id = camera_2),
    top AS MATERIALIZED (SELECT camera_1, camera_2, kp_1, min({{'distance': distance, 'kp_2': kp_2}}, 2) AS two FROM dist GROUP BY camera_1, camera_2, kp_1),
    nn AS (SELECT camera_1, camera_2, kp_1, u.kp_2, u.distance, rank FROM (SELECT camera_1, camera_2, kp_1, unnest(two) AS u, generate_subscripts(two, 1) AS rank FROM top))"""


_TWO = _knn(PAIR_WINDOW) + """, firsts AS (SELECT camera_1, camera_2, kp_1, two[1].kp_2 AS kp_2, two[1].distance AS distance, two[2].distance AS second FROM top WHERE len(two) = 2)"""
_RATIO = _TWO + f""", good AS (SELECT camera_1, camera_2, kp_1, kp_2, distance FROM firsts WHERE distance < {RATIO}::DOUBLE * second)"""
_NODES = _RATIO + """, links AS (SELECT DISTINCT a, b FROM (SELECT camera_1 * 4294967296 + kp_1 AS a, camera_2 * 4294967296 + kp_2 AS b FROM good
    UNION ALL SELECT camera_2 * 4294967296 + kp_2, camera_1 * 4294967296 + kp_1 FROM good)),
    reach AS (SELECT DISTINCT a AS node, a AS low FROM links UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node),
    comps AS (SELECT node, min(low) AS component FROM reach GROUP BY node)"""
_TRACKS = _NODES + """, one AS (SELECT component, CAST(node // 4294967296 AS INT) AS camera_id, CAST(min(node % 4294967296) AS INT) AS kp_idx FROM comps GROUP BY 1, 2),
    lm AS (SELECT component, CAST(row_number() OVER (ORDER BY component) - 1 AS INT) AS landmark_id FROM one GROUP BY component HAVING count(*) >= 2),
    obs AS (SELECT landmark_id, component, o.camera_id, o.kp_idx, k.x AS px, k.y AS py FROM one o JOIN lm USING (component) JOIN kps k ON k.camera_id = o.camera_id AND k.kp_idx = o.kp_idx)"""


def _verified() -> str:
    """SQL for the seven-point search: each hypothesis' null space by elimination, the cubic's roots, then all matches."""
    prime, ends, size = 2147483647, [], matching.FIRST_ROUND
    limit = matching.hypotheses_needed(LEAST_SHARE)
    while not ends or ends[-1] < limit:
        ends.append(min((ends[-1] if ends else 0) + size, limit))
        size *= 4
    # the parts of a pair are numbered from 0, as are the matches of a part
    part = "CAST(ceil(any_value(n) / %d) AS BIGINT)" % matching.CHUNK
    out = [f"""{_RATIO}, met AS MATERIALIZED (SELECT camera_1, camera_2, kp_1, kp_2, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, count(*) OVER (PARTITION BY camera_1, camera_2) AS n,
        row_number() OVER (PARTITION BY camera_1, camera_2 ORDER BY kp_1, kp_2) - 1 AS i FROM good JOIN kps a ON a.camera_id = camera_1 AND a.kp_idx = kp_1 JOIN kps b ON b.camera_id = camera_2 AND b.kp_idx = kp_2 QUALIFY n >= 8),
      pairs_of AS (SELECT camera_1, camera_2, any_value(n) AS n, {part} AS parts, avg(x1) AS ax, avg(y1) AS ay, avg(x2) AS bx, avg(y2) AS by_ FROM met GROUP BY 1, 2),
      d0 AS (SELECT p.*, h, h % parts AS part, (n - h % parts + parts - 1) // parts AS m, []::BIGINT[] AS s FROM pairs_of p, range({limit}) r(h))"""]
    for k in range(7):
        x = f"((h * 7 + {k + 1}) * 16807 % {prime})"
        y = f"(({x} * {x} + 12345) % {prime} * 48271 % {prime})"
        pick = f"(({y} * {y} + 54321) % {prime} % (m - {7 - k - 1}))"
        out.append(f"d{k + 1} AS (SELECT * REPLACE (list_append(s, CASE WHEN list_contains(s, {pick}) THEN m - {7 - k} ELSE {pick} END) AS s) FROM d{k})")
    out.append("""e0 AS MATERIALIZED (SELECT d.camera_1, d.camera_2, d.h, any_value(d.ax) AS ax, any_value(d.ay) AS ay, any_value(d.bx) AS bx, any_value(d.by_) AS by_, []::BIGINT[] AS pivots,
        list([u2 * u1, u2 * v1, u2, v2 * u1, v2 * v1, v2, u1, v1, 1.0::DOUBLE] ORDER BY k) AS a
      FROM (SELECT *, unnest(s) AS place, unnest(range(7)) AS k FROM d7) d JOIN met ON met.camera_1 = d.camera_1 AND met.camera_2 = d.camera_2 AND met.i = d.part + d.parts * d.place,
        LATERAL (SELECT (x1 - ax) / 100 AS u1, (y1 - ay) / 100 AS v1, (x2 - bx) / 100 AS u2, (y2 - by_) / 100 AS v2) GROUP BY 1, 2, 3)""")
    for k in range(7):
        out.append(f"""e{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (p, line) REPLACE (list_append(pivots, p) AS pivots, list_transform(a, lambda r, i: CASE WHEN i = {k + 1} THEN line ELSE list_transform(r, lambda v, j: v - r[p] * line[j]) END) AS a)
          FROM (SELECT *, list_transform(a[{k + 1}], lambda v: v / a[{k + 1}][p]) AS line FROM (SELECT *, list_position(list_transform(a[{k + 1}], lambda v: abs(v)), list_max(list_transform(a[{k + 1}], lambda v: abs(v)))) AS p FROM e{k})) WHERE abs(a[{k + 1}][p]) > 1e-9::DOUBLE)""")
    det = lambda m: f"({m}[1] * ({m}[5] * {m}[9] - {m}[6] * {m}[8]) - {m}[2] * ({m}[4] * {m}[9] - {m}[6] * {m}[7]) + {m}[3] * ({m}[4] * {m}[8] - {m}[5] * {m}[7]))"
    # the determinant of f + t g at t = 1 and -1 gives the middle coefficients
    newton = "t - (((t + c2) * t + c1) * t + c0) / ((3 * t + 2 * c2) * t + c1)"
    out.append(f"""free AS (SELECT *, list_filter(range(1, 10), lambda j: NOT list_contains(pivots, j)) AS rest FROM e7),
      spans AS (SELECT * EXCLUDE (a, pivots, rest), list_transform(range(1, 10), lambda j: CASE WHEN j = rest[1] THEN 1.0::DOUBLE WHEN j = rest[2] THEN 0 ELSE -a[list_position(pivots, j)][rest[1]] END) AS f,
        list_transform(range(1, 10), lambda j: CASE WHEN j = rest[2] THEN 1.0::DOUBLE WHEN j = rest[1] THEN 0 ELSE -a[list_position(pivots, j)][rest[2]] END) AS g FROM free),
      unit AS (SELECT * REPLACE (list_transform(f, lambda v: v / sqrt(list_dot_product(f, f))) AS f, list_transform(g, lambda v: v / sqrt(list_dot_product(g, g))) AS g) FROM spans),
      sums AS (SELECT *, list_transform(range(1, 10), lambda j: f[j] + g[j]) AS plus, list_transform(range(1, 10), lambda j: f[j] - g[j]) AS minus FROM unit),
      dets AS (SELECT * EXCLUDE (plus, minus), {det("f")} AS k0, {det("g")} AS k3, {det("plus")} AS dp, {det("minus")} AS dm FROM sums),
      turned AS (SELECT camera_1, camera_2, h, ax, ay, bx, by_, CASE WHEN abs(k0) > abs(k3) THEN g ELSE f END AS f, CASE WHEN abs(k0) > abs(k3) THEN f ELSE g END AS g,
        CASE WHEN abs(k0) > abs(k3) THEN [k3, (dp + dm) / 2 - k0, (dp - dm) / 2 - k3, k0] ELSE [k0, (dp - dm) / 2 - k3, (dp + dm) / 2 - k0, k3] END AS c FROM dets),
      cubic AS (SELECT *, c[1] / c[4] AS c0, c[2] / c[4] AS c1, c[3] / c[4] AS c2 FROM turned WHERE list_max(list_transform(c, lambda v: abs(v))) > 1e-9::DOUBLE),
      bent AS (SELECT *, c1 - c2 * c2 / 3 AS u, 2 * c2 * c2 * c2 / 27 - c2 * c1 / 3 + c0 AS v FROM cubic),
      split AS (SELECT *, v * v / 4 + u * u * u / 27 AS sq FROM bent),
      roots AS (SELECT * EXCLUDE (c), unnest(CASE WHEN sq > 0 THEN [one - u / (3 * one)] ELSE list_transform(range(3), lambda j: 2 * sqrt(greatest(-u / 3, 0)) * cos((acos(greatest(-1, least(1, 1.5::DOUBLE * v / u * sqrt(greatest(-3 / u, 0))))) - 2 * pi() * j) / 3)) END) - c2 / 3 AS t
        FROM (SELECT *, CASE WHEN sq > 0 THEN cbrt(-v / 2 - (CASE WHEN v < 0 THEN -1 ELSE 1 END) * sqrt(greatest(sq, 0))) END AS one FROM split)),
      once AS (SELECT * REPLACE ({newton} AS t) FROM roots), twice AS (SELECT * REPLACE ({newton} AS t) FROM once),
      models AS MATERIALIZED (SELECT camera_1, camera_2, h, t, ax, ay, bx, by_, list_transform(range(1, 10), lambda j: f[j] + t * g[j]) AS f FROM twice WHERE isfinite(t)),
      far AS (SELECT m.camera_1, m.camera_2, h, t, kp_1, kp_2, CASE WHEN la1 * la1 + la2 * la2 > {matching.EPIPOLE}::DOUBLE * na * (u2 * u2 + v2 * v2 + 1) AND lb1 * lb1 + lb2 * lb2 > {matching.EPIPOLE}::DOUBLE * nb * (u1 * u1 + v1 * v1 + 1)
          THEN e * e / least(la1 * la1 + la2 * la2, lb1 * lb1 + lb2 * lb2) END AS far FROM models m JOIN met ON met.camera_1 = m.camera_1 AND met.camera_2 = m.camera_2,
        LATERAL (SELECT (x1 - ax) / 100 AS u1, (y1 - ay) / 100 AS v1, (x2 - bx) / 100 AS u2, (y2 - by_) / 100 AS v2), LATERAL (SELECT f[1] * u2 + f[4] * v2 + f[7] AS la1, f[2] * u2 + f[5] * v2 + f[8] AS la2, f[1] * u1 + f[2] * v1 + f[3] AS lb1, f[4] * u1 + f[5] * v1 + f[6] AS lb2),
        LATERAL (SELECT u2 * lb1 + v2 * lb2 + f[7] * u1 + f[8] * v1 + f[9] AS e, list_sum(list_transform([1, 2, 4, 5, 7, 8], lambda j: f[j] * f[j])) AS na, list_sum(list_transform(range(1, 7), lambda j: f[j] * f[j])) AS nb)),
      judged AS MATERIALIZED (SELECT camera_1, camera_2, h, t, count(*) FILTER (far <= {EPIPOLAR}::DOUBLE / 100 * {EPIPOLAR} / 100) AS inliers, sum(far) FILTER (far <= {EPIPOLAR}::DOUBLE / 100 * {EPIPOLAR} / 100) AS cost FROM far GROUP BY 1, 2, 3, 4),
      ends AS (SELECT unnest({ends}) AS last),
      after AS (SELECT camera_1, camera_2, last, max(greatest(inliers / n, {LEAST_SHARE}::DOUBLE)) AS share FROM judged JOIN pairs_of USING (camera_1, camera_2), ends WHERE h < last GROUP BY 1, 2, 3),
      stops AS (SELECT camera_1, camera_2, min(last) AS last FROM after WHERE last = {limit} OR ceil(ln(0.01::DOUBLE) / ln(1 - least(pow(share, 7), 1 - 1e-12::DOUBLE))) <= last GROUP BY 1, 2),
      best AS (SELECT j.* FROM judged j JOIN stops s ON s.camera_1 = j.camera_1 AND s.camera_2 = j.camera_2 AND h < last QUALIFY row_number() OVER (PARTITION BY j.camera_1, j.camera_2 ORDER BY inliers DESC, cost, h) = 1)
      SELECT met.camera_1, met.camera_2, met.kp_1, met.kp_2, coalesce(far.far <= {EPIPOLAR}::DOUBLE / 100 * {EPIPOLAR} / 100, false) AS inlier
      FROM met LEFT JOIN best b ON b.camera_1 = met.camera_1 AND b.camera_2 = met.camera_2 LEFT JOIN far ON far.camera_1 = met.camera_1 AND far.camera_2 = met.camera_2 AND far.kp_1 = met.kp_1 AND far.kp_2 = met.kp_2 AND far.h = b.h AND far.t = b.t""")
    return "WITH " + ", ".join(out)


_ASOF = """sec AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6::DOUBLE AS ts, value FROM events),
    met AS (SELECT f.event_id, f.user_id, any_value(f.ts - 0.4::DOUBLE) AS t0, arg_max(k.event_id, k.ts) FILTER (k.ts < f.ts - 0.4::DOUBLE) AS pid, max(k.ts) FILTER (k.ts < f.ts - 0.4::DOUBLE) AS pts,
      arg_max(k.value, k.ts) FILTER (k.ts < f.ts - 0.4::DOUBLE) AS pv, arg_min(k.event_id, k.ts) FILTER (k.ts >= f.ts - 0.4::DOUBLE) AS nid, min(k.ts) FILTER (k.ts >= f.ts - 0.4::DOUBLE) AS nts,
      arg_min(k.value, k.ts) FILTER (k.ts >= f.ts - 0.4::DOUBLE) AS nv
    FROM (SELECT * FROM sec WHERE event_type = 'click') f LEFT JOIN (SELECT * FROM sec WHERE event_type = 'view') k USING (user_id) GROUP BY f.event_id, f.user_id)"""
_POSES = """raw AS (SELECT event_id, user_id, epoch_us(ts) / 1e6::DOUBLE AS ts, sin(value / 100) AS a, cos(value / 70) / 2 AS b, value / 200 AS c, 1.5::DOUBLE AS w, user_id / 10 AS tx, value / 25 AS ty, CAST(event_id % 17 AS DOUBLE) AS tz FROM events),
    poses AS (SELECT event_id, user_id, ts, a / n AS qx, b / n AS qy, c / n AS qz, w / n AS qw, tx, ty, tz FROM (SELECT *, sqrt(a * a + b * b + c * c + w * w) AS n FROM raw))"""
_OBS = f"""{_POINTS}, {_SEEN}, {_CELLS}, keyed AS (SELECT l_orderkey AS landmark_id, l_linenumber AS kp_idx, CAST(l_suppkey % 10 AS INT) AS camera_id, 50::DOUBLE * ((l_quantity - 25.5::DOUBLE) / 10) / 2 + 32 AS px,
    50::DOUBLE * ((l_discount - 0.05::DOUBLE) * 20) / 2 + 24 AS py, CASE WHEN l_orderkey % 3 > 0 THEN l_linenumber + 0.5::DOUBLE END AS old FROM lineitem),
    looked AS (SELECT landmark_id, kp_idx, k.camera_id, coalesce(c.depth, old) AS depth FROM keyed k LEFT JOIN cells c ON c.camera_id = k.camera_id AND c.u = round(px) AND c.v = round(py))"""


def _rotated(q: str, x: str, y: str, z: str) -> tuple[str, str, str]:
    """The rotation of a vector, spelled out."""
    ux, uy, uz = (f"(2 * ({q}qy * ({z}) - {q}qz * ({y})))", f"(2 * ({q}qz * ({x}) - {q}qx * ({z})))", f"(2 * ({q}qx * ({y}) - {q}qy * ({x})))")
    return (
        f"({x} + {q}qw * {ux} + ({q}qy * {uz} - {q}qz * {uy}))",
        f"({y} + {q}qw * {uy} + ({q}qz * {ux} - {q}qx * {uz}))",
        f"({z} + {q}qw * {uz} + ({q}qx * {uy} - {q}qy * {ux}))",
    )


_ACT = _rotated("", "1.0::DOUBLE", "-2.0::DOUBLE", "0.5::DOUBLE")
_BACK = _rotated("", "-tx", "-ty", "-tz")
_MOVED = _rotated("a.", "b.tx", "b.ty", "b.tz")
_INVERSE_Q = "(SELECT event_id, -qx AS qx, -qy AS qy, -qz AS qz, qw, tx, ty, tz FROM poses)"

_CAMERAS = "cameras AS (SELECT CAST(n_nationkey AS INT) AS camera_id, 0.0::DOUBLE AS qx, (n_nationkey / 100) / sqrt((n_nationkey / 100) * (n_nationkey / 100) + 1) AS qy, 0.0::DOUBLE AS qz, 1 / sqrt((n_nationkey / 100) * (n_nationkey / 100) + 1) AS qw, n_nationkey / 20 AS tx, 0.0::DOUBLE AS ty, 0.1::DOUBLE AS tz FROM nation WHERE n_nationkey < 10)"
_WORLD = _rotated("i.", "(wx - tx)", "(wy - ty)", "(wz - tz)")
_SEEN_AGAIN = _rotated("c.", "m.x", "m.y", "m.z")
_BACKED = "points AS MATERIALIZED (SELECT landmark_id AS id, " + ", ".join(f"{e} AS {c}" for c, e in zip("xyz", _rotated("i.", "(wx - tx)", "(wy - ty)", "(wz - tz)"), strict=True)) + " FROM (SELECT e.*, (px - 32) / 50 * depth AS wx, (py - 24) / 50 * depth AS wy, depth AS wz, tx, ty, tz, -qx AS qx, -qy AS qy, -qz AS qz, qw FROM enough e JOIN cameras USING (camera_id)) i)"
_TRIANGULATED = f"""{_OBS.replace("points AS", "raw AS").replace("FROM points", "FROM raw")}, {_CAMERAS},
      pix AS MATERIALIZED (SELECT k.landmark_id, k.kp_idx, k.camera_id, px, py, coalesce(c.depth, old) AS depth FROM keyed k LEFT JOIN cells c ON c.camera_id = k.camera_id AND c.u = round(px) AND c.v = round(py)),
      enough AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY landmark_id) AS n FROM pix WHERE depth > 0) WHERE n >= 2),
      {_median(_BACKED)},
      cam AS (SELECT e.landmark_id, e.camera_id, e.kp_idx, px, py, {_SEEN_AGAIN[0]} + c.tx AS x, {_SEEN_AGAIN[1]} + c.ty AS y, {_SEEN_AGAIN[2]} + c.tz AS z FROM enough e JOIN cameras c USING (camera_id) JOIN medians m ON m.id = e.landmark_id),
      judged AS MATERIALIZED (SELECT *, CASE WHEN z > 0 THEN sqrt((50 * x / z + 32 - px) * (50 * x / z + 32 - px) + (50 * y / z + 24 - py) * (50 * y / z + 24 - py)) <= 12 ELSE false END AS keep FROM cam),
      final AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY landmark_id) AS n2 FROM judged WHERE keep) WHERE n2 >= 2)"""
_LW = _rotated("k.", "p.x", "p.y", "p.z")
_CW = _rotated("f.", "a.x", "a.y", "a.z")
_DEPTH_MAPS = f"""WITH {_POINTS},
      f AS (SELECT CAST(n_nationkey AS INT) AS camera_id, n_nationkey * 4 AS matched, 0.0::DOUBLE AS qx, (n_nationkey / 200) / sqrt((n_nationkey / 200) * (n_nationkey / 200) + 1) AS qy, 0.0::DOUBLE AS qz, 1 / sqrt((n_nationkey / 200) * (n_nationkey / 200) + 1) AS qw, n_nationkey / 50 AS tx, 0.2::DOUBLE AS tz FROM nation),
      k AS (SELECT s_suppkey AS lidar_id, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, ((s_suppkey % 7) / 100) / sqrt(((s_suppkey % 7) / 100) * ((s_suppkey % 7) / 100) + 1) AS qz, 1 / sqrt(((s_suppkey % 7) / 100) * ((s_suppkey % 7) / 100) + 1) AS qw, (s_suppkey % 5) / 10 AS tx FROM supplier),
      a AS (SELECT k.lidar_id, {_LW[0]} + k.tx AS x, {_LW[1]} AS y, {_LW[2]} AS z FROM points p JOIN k ON k.lidar_id = p.lidar_id),
      c AS (SELECT f.camera_id, {_CW[0]} + f.tx AS x, {_CW[1]} AS y, {_CW[2]} + f.tz AS z FROM a JOIN f ON a.lidar_id BETWEEN greatest(0, matched - 50) AND matched + 50),
      s AS (SELECT camera_id, round(50::DOUBLE * x / z + 32) AS u, round(50::DOUBLE * y / z + 24) AS v, CAST(z AS FLOAT) AS depth FROM c WHERE z > 0)
      SELECT camera_id, CAST(v AS INT) AS v, CAST(u AS INT) AS u, round(CAST(min(depth) AS DOUBLE), 5) AS depth FROM s WHERE u >= 0 AND u < 64 AND v >= 0 AND v < 48 GROUP BY ALL"""

#: observations of the table scene (see `scene.from_tables`) and their squares at its start
_BA = f"""WITH {start_sql("truth", table_poses())}, {start_sql("start", start_poses())},
    points AS (SELECT o_orderkey AS landmark_id, 6 * (o_orderkey * 7919 % 1009 / 1009.0::DOUBLE) - 3 AS x, 4 * (o_orderkey * 104729 % 997 / 997.0::DOUBLE) - 2 AS y, 5 + 4 * (o_orderkey * 1299709 % 991 / 991.0::DOUBLE) AS z FROM orders),
    seen AS (SELECT DISTINCT l_orderkey AS landmark_id, CAST(l_suppkey % 10 AS INT) AS camera_id FROM lineitem),
    placed AS (SELECT landmark_id, camera_id, p.x, p.y, p.z, r00 * p.x + r01 * p.y + r02 * p.z + t0 AS a, r10 * p.x + r11 * p.y + r12 * p.z + t1 AS b, r20 * p.x + r21 * p.y + r22 * p.z + t2 AS c FROM seen JOIN points p USING (landmark_id) JOIN truth USING (camera_id)),
    observed AS (SELECT landmark_id, camera_id, x + 0.05 AS x, y - 0.05 AS y, z + 0.1 AS z, 500 * a / c + 320 AS px, 500 * b / c + 240 AS py, c AS depth FROM placed WHERE c > 1),
    again AS (SELECT landmark_id, camera_id, px, py, depth, r00 * x + r01 * y + r02 * z + t0 AS a, r10 * x + r11 * y + r12 * z + t1 AS b, r20 * x + r21 * y + r22 * z + t2 AS c FROM observed JOIN start USING (camera_id)),
    squares AS (
      SELECT 'reprojection' AS block_type, landmark_id, camera_id, (500 * a / c + 320 - px) * (500 * a / c + 320 - px) + (500 * b / c + 240 - py) * (500 * b / c + 240 - py) AS square FROM again
      UNION ALL SELECT 'depth', landmark_id, camera_id, (c - depth) * (c - depth) FROM again)"""

ORACLES: dict[str, str] = {
    "zbuffer_min_depth": f"WITH {_POINTS}, {_SEEN}, {_CELLS} SELECT camera_id, v, u, depth FROM cells",
    "zbuffer_accumulate": f"""WITH {_POINTS}, {_SEEN}, moved AS (SELECT CAST(lidar_id % 10 AS INT) AS camera_id, x + 0.25::DOUBLE AS x, y, z - 0.125::DOUBLE AS z FROM points),
      seen2 AS (SELECT camera_id, round(50::DOUBLE * x / z + 32) AS u, round(50::DOUBLE * y / z + 24) AS v, CAST(z AS FLOAT) AS depth FROM moved WHERE z > 0)
      SELECT camera_id, CAST(v AS INT) AS v, CAST(u AS INT) AS u, CAST(min(depth) AS DOUBLE) AS depth FROM (SELECT * FROM seen UNION ALL SELECT * FROM seen2) WHERE u >= 0 AND u < 64 AND v >= 0 AND v < 48 GROUP BY ALL""",
    "cull_counts": f"""WITH {_POINTS}, wide AS (SELECT lidar_id, round(500::DOUBLE * x / z + 320) AS u, round(500::DOUBLE * y / z + 240) AS v FROM points WHERE z > 0), inside AS (SELECT * FROM wide WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480)
      SELECT 'points' AS metric, count(*) AS value FROM points UNION ALL SELECT 'in_front', count(*) FROM points WHERE z > 0 UNION ALL SELECT 'in_image', count(*) FROM inside UNION ALL SELECT 'cells', count(*) FROM (SELECT DISTINCT lidar_id, v, u FROM inside)""",
    "asof_interpolate": f"""WITH {_ASOF} SELECT event_id, user_id, CASE WHEN pid IS NULL AND nid IS NULL THEN NULL WHEN pid IS NULL THEN 'clamp_first' WHEN nid IS NULL THEN 'clamp_last' ELSE 'between' END AS branch,
      round(CASE WHEN pid IS NOT NULL AND nid IS NOT NULL THEN (1 - least(1.0::DOUBLE, greatest(0.0::DOUBLE, (t0 - pts) / (nts - pts)))) * pv + least(1.0::DOUBLE, greatest(0.0::DOUBLE, (t0 - pts) / (nts - pts))) * nv ELSE coalesce(pv, nv) END, 6) AS interpolated FROM met""",
    "asof_matched_id": f"WITH {_ASOF} SELECT event_id, coalesce(pid, nid) AS matched_id FROM met",
    "asof_pose": f"""WITH {_ASOF}, {_POSES}, two AS (SELECT m.event_id, (t0 - pts) / (nts - pts) AS al, p.* RENAME (event_id AS e1), n.qx AS nx, n.qy AS ny, n.qz AS nz, n.qw AS nw, n.tx AS mx, n.ty AS my, n.tz AS mz, p.qx * n.qx + p.qy * n.qy + p.qz * n.qz + p.qw * n.qw AS dot
        FROM met m JOIN poses p ON p.event_id = pid JOIN poses n ON n.event_id = nid),
      ang AS (SELECT *, CASE WHEN abs(dot) < 1 - 2.220446049250313e-16::DOUBLE THEN acos(least(abs(dot), 1.0::DOUBLE)) END AS th FROM two),
      wt AS (SELECT *, CASE WHEN th IS NOT NULL THEN sin((1 - al) * th) / sin(th) ELSE 1 - al END AS wa, (CASE WHEN th IS NOT NULL THEN sin(al * th) / sin(th) ELSE al END) * (CASE WHEN dot < 0 THEN -1 ELSE 1 END) AS wb FROM ang),
      q AS (SELECT event_id, wa * qx + wb * nx AS x, wa * qy + wb * ny AS y, wa * qz + wb * nz AS z, wa * qw + wb * nw AS w, (1 - al) * tx + al * mx AS tx, (1 - al) * ty + al * my AS ty, (1 - al) * tz + al * mz AS tz FROM wt)
      SELECT event_id, round(x / n, 5) AS qx, round(y / n, 5) AS qy, round(z / n, 5) AS qz, round(w / n, 5) AS qw, round(tx, 5) AS tx, round(ty, 5) AS ty, round(tz, 5) AS tz FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS n FROM q)""",
    "lidar_window_join": "SELECT CAST(c_custkey AS INT) AS camera_id, CAST(s_suppkey AS INT) AS lidar_id FROM customer JOIN supplier ON s_suppkey BETWEEN greatest(0, c_custkey % 97 - 50) AND c_custkey % 97 + 50",
    "required_ids_distinct": "SELECT DISTINCT CAST(unnest(generate_series(greatest(0, c_custkey % 97 - 50), c_custkey % 97 + 50)) AS INT) AS lidar_id FROM customer",
    "pairs_sequential": f"WITH {_CAMS} SELECT a.camera_id AS camera_1, b.camera_id AS camera_2 FROM cams a JOIN cams b ON b.pos > a.pos AND b.pos <= a.pos + {PAIR_WINDOW}",
    "pairs_exhaustive": f"WITH {_CAMS} SELECT a.camera_id AS camera_1, b.camera_id AS camera_2 FROM cams a JOIN cams b ON b.pos > a.pos",
    "knn2_l2": f"WITH {_knn(2)} SELECT camera_1, camera_2, kp_1, kp_2, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM nn WHERE rank <= 2",
    "lowe_ratio": f"WITH {_RATIO} SELECT camera_1, camera_2, kp_1, kp_2, round(distance, 6) AS distance FROM good",
    "pair_gate": f"WITH {_RATIO} SELECT camera_1, camera_2, kp_1, kp_2 FROM (SELECT *, count(*) OVER (PARTITION BY camera_1, camera_2) AS n FROM good) WHERE n >= 8",
    "verified_matches": _verified(),
    "keyframes_from_text": f"WITH {_POSES} SELECT CAST(p.event_id AS INT) AS lidar_id, 'clouds/{{' || p.event_id || '}}.ply' AS ply_path, round(p.ts, 3) AS ts, {', '.join(f'round(p.{c}, 6) AS {c}' for c in ('qx', 'qy', 'qz', 'qw', 'tx', 'ty', 'tz'))} FROM poses p JOIN events e USING (event_id) WHERE event_type = 'view'",
    "match_pixels": f"""WITH {_RATIO} SELECT camera_1, camera_2, kp_1, kp_2, round(a.x, 6) AS x1, round(a.y, 6) AS y1, round(b.x, 6) AS x2, round(b.y, 6) AS y2
      FROM good JOIN kps a ON a.camera_id = camera_1 AND a.kp_idx = kp_1 JOIN kps b ON b.camera_id = camera_2 AND b.kp_idx = kp_2""",
    "low_inlier_pairs": f"WITH {_RATIO} SELECT camera_1, camera_2, count(*) AS n_matches, CAST(sum(CASE WHEN distance < {INLIER}::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS n_inliers FROM good GROUP BY 1, 2 HAVING sum(CASE WHEN distance < {INLIER}::DOUBLE THEN 1 ELSE 0 END) / count(*) < 0.5",
    "connected_components": f"WITH RECURSIVE {_NODES} SELECT CAST(node // 4294967296 AS INT) AS camera_id, CAST(node % 4294967296 AS INT) AS kp_idx, component FROM comps",
    "track_observations": f"WITH RECURSIVE {_TRACKS} SELECT landmark_id, component, camera_id, kp_idx, round(px, 6) AS px, round(py, 6) AS py FROM obs",
    "track_length_hist": f"WITH RECURSIVE {_TRACKS}, n AS (SELECT landmark_id, count(*) AS length FROM obs GROUP BY 1) SELECT length, count(*) AS n_tracks, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM n GROUP BY length",
    "depth_lookup": f"WITH {_OBS} SELECT landmark_id, kp_idx, camera_id, depth FROM looked",
    "min_support": f"WITH {_OBS} SELECT landmark_id, count(*) AS n_observations FROM looked WHERE depth > 0 GROUP BY 1 HAVING count(*) >= 2",
    "backproject": f"WITH {_OBS} SELECT landmark_id, kp_idx, round((px - 32) / 50 * old, 6) AS x, round((py - 24) / 50 * old, 6) AS y, round(old, 6) AS z FROM keyed WHERE old IS NOT NULL",
    "reproject_filter": f"""WITH {_OBS}, posed AS (SELECT landmark_id, kp_idx, px, py, (landmark_id % 11 - 5) / 10 AS x, (landmark_id % 7 - 3) / 10 AS y, landmark_id % 5 + 0.5::DOUBLE AS z FROM keyed),
      cam AS (SELECT landmark_id, kp_idx, px, py, x * 0.28::DOUBLE + z * 0.96::DOUBLE + 0.05::DOUBLE AS x, y, z * 0.28::DOUBLE - x * 0.96::DOUBLE + 0.1::DOUBLE AS z FROM posed),
      err AS (SELECT landmark_id, kp_idx, sqrt((50 * x / z + 32 - px) * (50 * x / z + 32 - px) + (50 * y / z + 24 - py) * (50 * y / z + 24 - py)) AS e FROM cam WHERE z > 0)
      SELECT landmark_id, kp_idx, round(e, 5) AS error FROM err WHERE e <= 40""",
    "trajectory_rmse": f"WITH {_POSES}, n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, tx, ty, tz) AS r FROM poses) SELECT user_id, count(*) AS n, round(sqrt(avg((r * 0.01::DOUBLE) * (r * 0.01::DOUBLE) + 0.25::DOUBLE)), 6) AS rmse FROM n GROUP BY 1",
    "trajectory_pair_rmse": f"""WITH {_POSES}, a AS (SELECT *, row_number() OVER (ORDER BY ts, tx, ty, tz) AS r FROM poses WHERE event_id % 2 = 0), b AS (SELECT *, row_number() OVER (ORDER BY ts, tx, ty, tz) AS r FROM poses WHERE event_id % 2 = 1)
      SELECT count(*) AS n, CASE WHEN count(*) = count(a.tx + b.tx) THEN round(sqrt(avg((a.tx - b.tx) * (a.tx - b.tx) + (a.ty - b.ty) * (a.ty - b.ty) + (a.tz - b.tz) * (a.tz - b.tz))), 6) END AS rmse FROM a FULL JOIN b USING (r)""",
    "trajectory_heading": f"""WITH {_POSES}, h AS (SELECT event_id, 2 * (qx * qz + qw * qy) AS x, 2 * (qy * qz - qw * qx) AS y, 1 - 2 * (qx * qx + qy * qy) AS z FROM poses), n AS (SELECT *, sqrt(x * x + y * y + z * z) AS s FROM h)
      SELECT event_id, round(x / s, 6) AS hx, round(y / s, 6) AS hy, round(z / s, 6) AS hz FROM n""",
    "align_start": f"WITH {_POSES} SELECT event_id, round(tx - first(tx) OVER w, 6) AS tx, round(ty - first(ty) OVER w, 6) AS ty, round(tz - first(tz) OVER w, 6) AS tz FROM poses WINDOW w AS (PARTITION BY user_id ORDER BY ts, tx, ty, tz ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "slerp": f"""WITH {_POSES}, two AS (SELECT a.event_id, a.qx, a.qy, a.qz, a.qw, b.qx AS x, b.qy AS y, b.qz AS z, b.qw AS w, a.qx * b.qx + a.qy * b.qy + a.qz * b.qz + a.qw * b.qw AS dot FROM poses a JOIN poses b ON a.event_id = b.event_id + 1),
      t AS (SELECT *, CASE WHEN abs(dot) < 1 - 2.220446049250313e-16::DOUBLE THEN acos(least(abs(dot), 1.0::DOUBLE)) END AS th FROM two),
      k AS (SELECT *, CASE WHEN th IS NOT NULL THEN sin(0.75::DOUBLE * th) / sin(th) ELSE 0.75 END AS wa, CASE WHEN th IS NOT NULL THEN sin(0.25::DOUBLE * th) / sin(th) ELSE 0.25 END * CASE WHEN dot < 0 THEN -1 ELSE 1 END AS wb FROM t)
      SELECT event_id, round(wa * qx + wb * x, 5) AS qx, round(wa * qy + wb * y, 5) AS qy, round(wa * qz + wb * z, 5) AS qz, round(wa * qw + wb * w, 5) AS qw FROM k""",
    "se3_compose": f"""WITH {_POSES}, c AS (SELECT a.event_id, a.qw * b.qx + a.qx * b.qw + a.qy * b.qz - a.qz * b.qy AS x, a.qw * b.qy + a.qy * b.qw + a.qz * b.qx - a.qx * b.qz AS y, a.qw * b.qz + a.qz * b.qw + a.qx * b.qy - a.qy * b.qx AS z,
        a.qw * b.qw - a.qx * b.qx - a.qy * b.qy - a.qz * b.qz AS w, {_MOVED[0]} + a.tx AS tx, {_MOVED[1]} + a.ty AS ty, {_MOVED[2]} + a.tz AS tz FROM poses a JOIN poses b ON a.event_id = b.event_id + 1), n AS (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS s FROM c)
      SELECT event_id, round(x / s, 6) AS qx, round(y / s, 6) AS qy, round(z / s, 6) AS qz, round(w / s, 6) AS qw, round(tx, 6) AS tx, round(ty, 6) AS ty, round(tz, 6) AS tz FROM n""",
    "se3_inverse": f"WITH {_POSES} SELECT event_id, round(qx, 6) AS qx, round(qy, 6) AS qy, round(qz, 6) AS qz, round(qw, 6) AS qw, round({_BACK[0]}, 6) AS tx, round({_BACK[1]}, 6) AS ty, round({_BACK[2]}, 6) AS tz FROM {_INVERSE_Q}",
    "se3_act": f"WITH {_POSES} SELECT event_id, round({_ACT[0]} + tx, 6) AS x, round({_ACT[1]} + ty, 6) AS y, round({_ACT[2]} + tz, 6) AS z FROM poses",
    "axis_angles": f"""WITH {_POSES} SELECT event_id, round(atan2(2 * (qy * qz + qx * qw) - 2 * (qy * qz - qx * qw), (1 - 2 * (qx * qx + qz * qz)) + (1 - 2 * (qx * qx + qy * qy))), 5) AS angle_x,
      round(atan2(2 * (qx * qz + qy * qw) - 2 * (qx * qz - qy * qw), (1 - 2 * (qx * qx + qy * qy)) + (1 - 2 * (qy * qy + qz * qz))), 5) AS angle_y,
      round(atan2(2 * (qx * qy + qz * qw) - 2 * (qx * qy - qz * qw), (1 - 2 * (qy * qy + qz * qz)) + (1 - 2 * (qx * qx + qz * qz))), 5) AS angle_z FROM poses""",
    "se3_log": f"""WITH {_POSES}, r AS (SELECT *, sqrt(qx * qx + qy * qy + qz * qz) AS n FROM poses), w AS (SELECT *, 2 * atan2(n, qw) / n AS f FROM r),
      v AS (SELECT *, f * qx AS wx, f * qy AS wy, f * qz AS wz FROM w), s AS (SELECT *, wx * wx + wy * wy + wz * wz AS sq FROM v), g AS (SELECT *, (1 - (sqrt(sq) / 2) * cos(sqrt(sq) / 2) / sin(sqrt(sq) / 2)) / sq AS k,
        wy * tz - wz * ty AS cx, wz * tx - wx * tz AS cy, wx * ty - wy * tx AS cz FROM s)
      SELECT event_id, round(tx - 0.5::DOUBLE * cx + k * (wy * cz - wz * cy), 5) AS ux, round(ty - 0.5::DOUBLE * cy + k * (wz * cx - wx * cz), 5) AS uy, round(tz - 0.5::DOUBLE * cz + k * (wx * cy - wy * cx), 5) AS uz, round(wx, 5) AS wx, round(wy, 5) AS wy, round(wz, 5) AS wz FROM g""",
    "se3_exp": """WITH t AS (SELECT event_id, user_id / 50 AS ux, value / 100 AS uy, 0.3::DOUBLE AS uz, sin(value) AS wx, value / 90 AS wy, 0.2::DOUBLE AS wz FROM events), s AS (SELECT *, wx * wx + wy * wy + wz * wz AS sq, sqrt(wx * wx + wy * wy + wz * wz) AS th FROM t),
      g AS (SELECT *, sin(th / 2) / th AS im, (1 - cos(th)) / sq AS a, (th - sin(th)) / (sq * th) AS b, wy * uz - wz * uy AS cx, wz * ux - wx * uz AS cy, wx * uy - wy * ux AS cz FROM s)
      SELECT event_id, round(im * wx, 5) AS qx, round(im * wy, 5) AS qy, round(im * wz, 5) AS qz, round(cos(th / 2), 5) AS qw, round(ux + a * cx + b * (wy * cz - wz * cy), 5) AS tx, round(uy + a * cy + b * (wz * cx - wx * cz), 5) AS ty, round(uz + a * cz + b * (wx * cy - wy * cx), 5) AS tz FROM g""",
    "customer_components": _components("links AS (SELECT DISTINCT o_custkey AS a, l_partkey + 1000000000 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"),
    "customer_components_whole": _components("links AS (SELECT DISTINCT o_custkey AS a, l_suppkey + 1000000000 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"),
    "line_chain_components": _components("links AS (SELECT DISTINCT l_suppkey + 1000000000 AS a, l_partkey AS b FROM lineitem UNION SELECT p_partkey, p_partkey + 10 FROM part)"),
    "lowe_ratio_single": f"WITH {_TWO} SELECT camera_1, camera_2, kp_1, kp_2 FROM firsts WHERE CAST(distance AS FLOAT) < CAST({RATIO} AS FLOAT) * CAST(second AS FLOAT)",
    "lowe_ratio_capped": f"WITH {_RATIO} SELECT camera_1, camera_2, kp_1, kp_2, round(distance, 6) AS distance FROM good WHERE distance <= 1.05::DOUBLE",
    "inlier_gate": f"WITH {_RATIO}, judged AS (SELECT *, distance < {INLIER}::DOUBLE AS inlier FROM good) SELECT camera_1, camera_2, kp_1, kp_2, inlier FROM (SELECT *, count(*) FILTER (inlier) OVER (PARTITION BY camera_1, camera_2) AS n FROM judged) WHERE n >= {LEAST_INLIERS}",
    "inlier_components": f"WITH RECURSIVE {_NODES.replace('FROM good', f'FROM good WHERE distance < {INLIER}::DOUBLE')} SELECT CAST(node // 4294967296 AS INT) AS camera_id, CAST(node % 4294967296 AS INT) AS kp_idx, component FROM comps",
    "pair_stats": f"WITH {_RATIO} SELECT camera_1, camera_2, count(*) AS n_matches, count(*) FILTER (distance < {INLIER}::DOUBLE) AS n_inliers, round(count(*) FILTER (distance < {INLIER}::DOUBLE) / count(*), 9) AS share FROM good GROUP BY 1, 2",
    "track_length_stats": f"""WITH RECURSIVE {_TRACKS}, n AS (SELECT landmark_id, count(*) AS length FROM obs GROUP BY 1)
      SELECT 'tracks' AS metric, CAST(count(*) AS DOUBLE) AS value FROM n UNION ALL SELECT 'observations', CAST(sum(length) AS DOUBLE) FROM n UNION ALL SELECT 'mean_length', round(avg(length), 6) FROM n UNION ALL SELECT 'share_of_three', round(avg((length >= 3)::INT), 6) FROM n""",
    "geometric_median": f"WITH RECURSIVE {_POINTS.replace('points AS', 'raw AS')}, {_median('points AS MATERIALIZED (SELECT lidar_id AS id, x, y, z FROM raw WHERE z > 0)')} SELECT id AS lidar_id, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM medians",
    "triangulated_landmarks": f"WITH RECURSIVE {_TRIANGULATED} SELECT f.landmark_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM (SELECT DISTINCT landmark_id FROM final) f LEFT JOIN medians m ON m.id = f.landmark_id",
    "triangulated_observations": f"WITH RECURSIVE {_TRIANGULATED} SELECT landmark_id, camera_id, kp_idx FROM final",
    "triangulation_metrics": f"""WITH RECURSIVE {_TRIANGULATED}, n AS (SELECT
        (SELECT count(*) FROM pix) AS a, (SELECT count(*) FROM enough) AS b, (SELECT count(*) FROM final) AS c, (SELECT count(DISTINCT landmark_id) FROM pix) AS d, (SELECT count(DISTINCT landmark_id) FROM final) AS e,
        (SELECT count(*) FROM pix WHERE depth IS NULL OR depth <= 0) AS f, (SELECT count(*) FROM judged WHERE NOT keep) AS g)
      SELECT 'observations' AS metric, a AS value FROM n UNION ALL SELECT 'with_depth', b FROM n UNION ALL SELECT 'kept', c FROM n UNION ALL SELECT 'landmarks', d FROM n UNION ALL SELECT 'landmarks_kept', e FROM n
      UNION ALL SELECT 'removed_without_depth', f FROM n UNION ALL SELECT 'removed_outliers', g FROM n UNION ALL SELECT 'removed_landmarks', d - e FROM n""",
    "observation_cameras": f"WITH {_OBS}, {_CAMERAS}, odd AS (SELECT landmark_id, kp_idx, CAST(CASE WHEN kp_idx = 7 THEN camera_id + 100 ELSE camera_id END AS INT) AS camera_id FROM keyed) SELECT landmark_id, kp_idx, odd.camera_id, round(tx, 6) AS tx, round(qy, 6) AS qy FROM odd LEFT JOIN cameras c ON c.camera_id = odd.camera_id",
    "depth_maps": _DEPTH_MAPS,
    "spline_positions": f"""WITH {_POSES}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, tx, ty, tz) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM poses),
      asked AS (SELECT user_id, n, t, least(CAST(floor(t / 0.5::DOUBLE) AS BIGINT), n - 2) AS i, t / 0.5::DOUBLE - least(CAST(floor(t / 0.5::DOUBLE) AS BIGINT), n - 2) AS u FROM (SELECT DISTINCT user_id, n FROM n), (SELECT unnest([0.0::DOUBLE, 1.3::DOUBLE, 4.75::DOUBLE]) AS t)),
      w AS (SELECT *, (5 + 3 * u - 3 * u * u + u * u * u) / 6 AS b1, (1 + 3 * u + 3 * u * u - 2 * u * u * u) / 6 AS b2, u * u * u / 6 AS b3, (3 - 6 * u + 3 * u * u) / 3 AS d1, (3 + 6 * u - 6 * u * u) / 3 AS d2, u * u AS d3, 4 * (u - 1) AS e1, 4 * (1 - 2 * u) AS e2, 4 * u AS e3 FROM asked WHERE n >= 2 AND t <= (n - 1) * 0.5::DOUBLE),
      four AS (SELECT w.*, a.tx AS ax, a.ty AS ay, a.tz AS az, b.tx AS bx, b.ty AS by_, b.tz AS bz, c.tx AS cx, c.ty AS cy, c.tz AS cz, d.tx AS dx, d.ty AS dy, d.tz AS dz FROM w JOIN n a ON a.user_id = w.user_id AND a.i = greatest(w.i - 1, 0) JOIN n b ON b.user_id = w.user_id AND b.i = w.i
        JOIN n c ON c.user_id = w.user_id AND c.i = w.i + 1 JOIN n d ON d.user_id = w.user_id AND d.i = least(w.i + 2, w.n - 1))
      SELECT asked.user_id, asked.t, round(ax + b1 * (bx - ax) + b2 * (cx - bx) + b3 * (dx - cx), 6) AS p0, round(ay + b1 * (by_ - ay) + b2 * (cy - by_) + b3 * (dy - cy), 6) AS p1, round(az + b1 * (bz - az) + b2 * (cz - bz) + b3 * (dz - cz), 6) AS p2,
        round(d1 * (bx - ax) + d2 * (cx - bx) + d3 * (dx - cx), 5) AS v0, round(d1 * (by_ - ay) + d2 * (cy - by_) + d3 * (dy - cy), 5) AS v1, round(d1 * (bz - az) + d2 * (cz - bz) + d3 * (dz - cz), 5) AS v2,
        round(e1 * (bx - ax) + e2 * (cx - bx) + e3 * (dx - cx), 5) AS a0, round(e1 * (by_ - ay) + e2 * (cy - by_) + e3 * (dy - cy), 5) AS a1, round(e1 * (bz - az) + e2 * (cz - bz) + e3 * (dz - cz), 5) AS a2
      FROM asked LEFT JOIN four ON four.user_id = asked.user_id AND four.t = asked.t""",
    "mean_positions": f"WITH {_POSES} SELECT user_id, round(avg(tx), 6) AS x, round(avg(ty), 6) AS y, round(avg(tz), 6) AS z FROM poses GROUP BY 1",
    "mean_turns": "SELECT user_id, round(avg(value / 1000), 6) AS angle FROM events GROUP BY 1",
    # rotations about y only: of the product's quaternion the second part, from the matrix
    "ba_solve": f"""WITH {start_sql("p", table_poses())}, q AS (SELECT * FROM p WHERE camera_id = 0),
      r AS (SELECT p.camera_id, p.r00 * q.r20 + p.r02 * q.r22 AS m02, p.r20 * q.r20 + p.r22 * q.r22 AS m22, p.r00 * q.r00 + p.r02 * q.r02 AS m00,
        p.r20 * q.r00 + p.r22 * q.r02 AS m20, p.t0 AS a0, p.t1 AS a1, p.t2 AS a2, q.t0 AS b0, q.t1 AS b1, q.t2 AS b2 FROM p, q)
      SELECT camera_id, round(sin(atan2(m02 - m20, m00 + m22) / 2), 3) + 0.0 AS qy, round(a0 - (m00 * b0 + m02 * b2), 3) + 0.0 AS tx, round(a1 - b1, 3) + 0.0 AS ty, round(a2 - (m20 * b0 + m22 * b2), 3) + 0.0 AS tz FROM r
      WHERE camera_id IN (SELECT l_suppkey % 10 FROM lineitem)""",
    "observation_residuals": f"{_BA} SELECT block_type, landmark_id, camera_id, round(square, 4) AS square FROM squares",
    "robust_cost_breakdown": f"""{_BA}, every AS (SELECT block_type, 0.5::DOUBLE * CASE WHEN square <= 1 THEN square ELSE 2 * sqrt(square) - 1 END AS cost FROM squares UNION ALL SELECT 'prior', 0 FROM start)
      SELECT block_type, count(*) AS blocks, round(sum(cost) / count(*), 5) AS cost FROM every GROUP BY 1""",
}
ORACLES["components_in_batches"] = ORACLES["connected_components"]

QUERIES = {
    f.__name__: f
    for f in (
        zbuffer_min_depth, zbuffer_accumulate, cull_counts, asof_interpolate, asof_matched_id, asof_pose, lidar_window_join, required_ids_distinct,
        pairs_sequential, pairs_exhaustive, knn2_l2, lowe_ratio, pair_gate, match_pixels, low_inlier_pairs, verified_matches, keyframes_from_text, connected_components, components_in_batches,
        lowe_ratio_single, lowe_ratio_capped, inlier_gate, inlier_components, pair_stats, track_length_stats, line_chain_components,
        spline_positions, mean_positions, mean_turns, triangulated_landmarks, triangulated_observations, triangulation_metrics, observation_cameras, depth_maps,
        track_observations, track_length_hist, customer_components, customer_components_whole, depth_lookup, min_support, backproject, reproject_filter, geometric_median,
        trajectory_rmse, trajectory_pair_rmse, trajectory_heading, align_start, slerp, se3_compose, se3_inverse, se3_act, se3_log, se3_exp, axis_angles,
        robust_cost_breakdown, observation_residuals, ba_solve, ba_alternation,
    )
}
