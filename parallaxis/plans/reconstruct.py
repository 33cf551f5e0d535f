"""Whole plans: loading, matching to tracks, the alternation of refinement, depth and triangulation, and all of it."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geometry as G
from ..functions import lie
from ..operators import associate, matching, solver, tracks, triangulate, zbuffer
from ..operators.components import save, shared_folder
from ..sources import images, readers, writers
from .rounds import Rounds

POSE = "struct<qx:double,qy:double,qz:double,qw:double,tx:double,ty:double,tz:double>"


def landmarks_of(keypoints: DataFrame, config: Config, exhaustive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(verified matches, observations) from keypoints (camera_id, kp_idx, x, y, descriptor)."""
    cameras = keypoints.select("camera_id").distinct().withColumn("has_descriptors", F.lit(True))
    pairs = matching.exhaustive_pairs(cameras) if exhaustive else matching.sequential_pairs(cameras, config.sequential_match_window_size)
    matches = save(matching.match(keypoints, pairs, config.ratio_threshold, config.ransac_threshold, config.min_inliers, config.sift_max_match_distance))
    return matches, tracks.observations(tracks.components(matches), keypoints)


def poses_of(frames: DataFrame, column: str) -> dict[int, np.ndarray]:
    """Camera-sized state as matrices."""
    out = {}
    for r in frames.select("camera_id", column).collect():
        p, m = r[column], np.eye(4)
        m[:3, :3], m[:3, 3] = lie.rotation(np.array([p.qx, p.qy, p.qz, p.qw])), (p.tx, p.ty, p.tz)
        out[r.camera_id] = m
    return out


def with_poses(frames: DataFrame, poses: dict[int, np.ndarray], column: str) -> DataFrame:
    rows = [(c, (*map(float, lie.quaternion(m[:3, :3])), *map(float, m[:3, 3]))) for c, m in poses.items()]
    table = frames.sparkSession.createDataFrame(rows, f"camera_id int, {column} {POSE}")
    return frames.drop(column).join(F.broadcast(table), "camera_id", "left")


@dataclass
class Outcome:
    frames: DataFrame
    landmarks: DataFrame
    observations: DataFrame
    costs: list[float] = field(default_factory=list)  # at the end of each round
    starts: list[float] = field(default_factory=list)  # at its start


def _listed(poses: dict[int, np.ndarray]) -> list:
    return [[int(c), m.tolist()] for c, m in sorted(poses.items())]


def _checksum(*tables: DataFrame) -> list:
    return [[int(x or 0) for x in t.agg(F.count("*"), F.bit_xor(F.xxhash64(*sorted(t.columns)))).first()] for t in tables]


def refine(
    frames: DataFrame, keyframes: DataFrame, points: DataFrame, observations: DataFrame, k: G.Intrinsics, config: Config, options: solver.Options | None = None,
    early_stop: bool = False, on_round=None, half: int = zbuffer.HALF_WINDOW, state: str | None = None,
) -> Outcome:
    """The alternation: refine poses and points, render depth with the refined poses, read the observations' depth,
    and triangulate anew, so only poses carry over from round to round.

    frames: (camera_id, matched_lidar_id, initial_pose, ...); observations: (landmark_id, camera_id, kp_idx, px, py).
    The depth buffer keeps its minimum over rounds; priors hold poses to the last refined ones.

    state: a shared folder in which each round is committed (see `rounds`): called again with it, the alternation goes on
    from the last whole round, and gives what it would have given without a break. Without one, rounds are kept in a
    folder of their own. Only the last round stays.
    """
    options = options or solver.Options(iterations=config.ceres_max_iterations)
    if config.num_iteration < 1:
        raise ValueError("num_iteration must be positive")
    threshold, spark = config.landmark_reprojection_error_threshold, frames.sparkSession
    mark = repr((options, threshold, half, k, _checksum(frames.select("camera_id", "matched_lidar_id", "initial_pose"), observations))) if state else ""
    kept = Rounds(spark, state or f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", mark)
    names = ["depth", "observations", "landmarks"]
    if "radius" not in points.columns:
        points = save(zbuffer.blocks(points))

    def finish(n: int, depth: DataFrame, obs: DataFrame, landmarks: DataFrame, poses: dict[int, np.ndarray], costs: list[float], starts: list[float], column: str):
        """Depth read and landmarks placed with the poses of a round, which is then whole."""
        obs = zbuffer.observation_depth(obs, depth, k)
        placed = with_poses(frames, poses, "__pose").select("camera_id", F.col("__pose").alias("pose"))
        made = triangulate.triangulate(landmarks, obs, placed, k, threshold, column)
        kept.write(n, "landmarks", made[0])
        kept.write(n, "observations", made[1])
        return kept.commit(n, names, {"poses": _listed(poses), "costs": costs, "starts": starts})

    if (found := kept.last()) is None:
        depth = kept.write(0, "depth", zbuffer.depth_maps(frames, keyframes, points, k, "initial_pose", half))
        obs = observations.withColumn("depth", F.lit(None).cast("double"))
        tables, record = finish(0, depth, obs, obs.select("landmark_id").distinct(), poses_of(frames, "initial_pose"), [], [], "initial_position")
        done = 0
    else:
        done, tables, record = found
    for n in range(done + 1, config.num_iteration + 1):
        costs = record["costs"]
        if early_stop and len(costs) > 1 and abs(costs[-2] - costs[-1]) < config.ba_cost_threshold * costs[-2]:
            break
        poses = {c: np.array(m) for c, m in record["poses"]}
        landmarks, column = tables["landmarks"], "optimized_position" if n > 1 else "initial_position"
        at = landmarks.where(F.col(column).isNotNull()).select("landmark_id", *[F.col(f"{column}.{c}").alias(c) for c in "xyz"])
        result = solver.optimize(poses, at, tables["observations"], k, options, poses)
        moved = with_poses(frames, result.poses, "optimized_pose")
        depth = kept.write(n, "depth", zbuffer.depth_maps(moved, keyframes, points, k, "optimized_pose", half, before=tables["depth"]))
        refined = landmarks.drop("optimized_position").join(result.landmarks.select("landmark_id", F.struct("x", "y", "z").alias("optimized_position")), "landmark_id", "left")
        tables, record = finish(n, depth, tables["observations"], refined, result.poses, [*costs, result.costs[-1]], [*record["starts"], result.costs[0]], "optimized_position")
        if on_round:
            on_round(n - 1, moved)
    poses = {c: np.array(m) for c, m in record["poses"]}
    return Outcome(with_poses(frames, poses, "optimized_pose"), tables["landmarks"], tables["observations"], record["costs"], record["starts"])


@dataclass
class Loaded:
    intrinsics: G.Intrinsics
    frames: DataFrame
    keyframes: DataFrame
    points: DataFrame


def load(spark, config: Config, half: int = zbuffer.HALF_WINDOW) -> Loaded:
    """Calibration, keyframes, images with their associated poses, and the clouds that any frame needs, written once."""
    camera_lidar = readers.pose_column(readers.extrinsics(spark, config.camera_extrinsic_path))
    keyframes = save(readers.keyframes(spark, config.lidar_kf_path, config.lidar_ply_dirs))
    listed = save(readers.images(spark, config.camera_timestamp_path, config.input_img_dir, config.max_images))
    width, height = images.first_size(spark, listed)
    k = readers.intrinsics(spark, config.camera_intrinsic_path, width, height)
    frames = save(associate.associate(listed, keyframes, camera_lidar))
    points = save(readers.points(spark, keyframes, config.lidar_ply_dirs, zbuffer.required_ids(frames, half)))
    return Loaded(k, frames, keyframes, points)


def fingerprint(keypoints: DataFrame, config: Config) -> str:
    """What a table of landmarks was made from: the settings that matter, and a checksum of the keypoints."""
    sums = keypoints.agg(F.count("*"), F.bit_xor(F.xxhash64("camera_id", "kp_idx", "x", "y", "descriptor"))).first()
    return repr((config.ratio_threshold, config.ransac_threshold, config.min_inliers, config.sift_max_match_distance, config.sequential_match_window_size, *sums))


def run(spark, config: Config, keypoints: DataFrame | None = None, options: solver.Options | None = None, half: int = zbuffer.HALF_WINDOW, state: str | None = None) -> Outcome:
    """From files to trajectories: everything that the settings name is read, and everything made is written under
    `output_path`: landmarks, a trajectory before, after each round and at the end, and the images file.

    keypoints: (camera_id, kp_idx, x, y, descriptor) where they are known; else they are detected in the images. Stored
    landmarks are used again if they were made from the same keypoints and settings. state: where the rounds of the
    refinement are committed; a run that is started again with it goes on from the last one.
    """
    loaded = load(spark, config, half)
    out = config.output_path.rstrip("/")
    writers.write_trajectory(loaded.frames, f"{out}/trajectory/initial.txt", "initial_pose")
    if keypoints is None:
        from ..operators.features import keypoints_of

        keypoints = save(keypoints_of(spark, loaded.frames, config))
    mark, cache = fingerprint(keypoints, config), f"{out}/landmarks"
    stored = writers.read_landmarks(spark, cache, mark)
    if stored is None:
        observations = landmarks_of(keypoints, config)[1]
        writers.write_landmarks(observations.select("landmark_id").distinct(), observations, cache, mark)
        stored = writers.read_landmarks(spark, cache, mark)
    done = refine(
        loaded.frames, loaded.keyframes, loaded.points, stored[1], loaded.intrinsics, config, options,
        on_round=lambda n, frames: writers.write_trajectory(frames, f"{out}/trajectory/iter_{n}.txt", "optimized_pose"), half=half, state=state,
    )
    writers.write_images(done.frames, f"{out}/images.txt")
    writers.write_trajectory(done.frames, f"{out}/trajectory/final.txt", "optimized_pose")
    return done
