"""A synthetic scene with a known truth, for the solver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lie
from ..functions.geometry import Intrinsics, act, project, vec
from ..operators import solver

K = Intrinsics(500.0, 500.0, 320.0, 240.0, 640, 480)

#: fixed values: three cameras (rotation vector, translation), their disturbances (translation, rotation), five landmarks
CAMERAS = {0: ((0, 0, 0), (0, 0, 0)), 1: ((0.05, -0.03, 0.02), (0.5, 0.1, -0.2)), 2: ((-0.04, 0.06, 0.01), (-0.3, 0.2, 0.3))}
DISTURBED = {0: (0.01, -0.01, 0.02, 0.03, -0.02, 0.01), 1: (-0.02, 0.015, -0.01, -0.02, 0.03, -0.015), 2: (0.015, 0.02, -0.02, 0.025, -0.01, 0.02)}
LANDMARKS = ((0.2, 0.1, 5.0), (-0.3, 0.4, 6.0), (0.5, -0.2, 4.5), (-0.1, -0.3, 5.5), (0.0, 0.0, 7.0))
SHIFT = (0.1, -0.1, 0.2)


def truth() -> tuple[dict[int, np.ndarray], np.ndarray]:
    poses = {}
    for c, (w, t) in CAMERAS.items():
        poses[c] = np.eye(4)
        poses[c][:3, :3], poses[c][:3, 3] = lie.so3_exp(np.array(w, float)), t
    return poses, np.array(LANDMARKS)


def tables(spark: SparkSession) -> tuple[dict[int, np.ndarray], DataFrame, DataFrame]:
    """(disturbed poses, disturbed landmarks, exact observations)."""
    poses, points = truth()
    start = {c: lie.se3_exp(np.array(DISTURBED[c])) @ p for c, p in poses.items()}
    landmarks = spark.createDataFrame([(i, *map(float, x + np.array(SHIFT))) for i, x in enumerate(points)], "landmark_id int, x double, y double, z double")
    rows = []
    for i, x in enumerate(points):
        for c, p in poses.items():
            q = p[:3, :3] @ x + p[:3, 3]
            rows.append((i, c, float(K.fx * q[0] / q[2] + K.cx), float(K.fy * q[1] / q[2] + K.cy), float(q[2])))
    return start, landmarks, spark.createDataFrame(rows, "landmark_id int, camera_id int, px double, py double, depth double")


def solved(spark: SparkSession) -> DataFrame:
    """(kind, id, error): how far refined poses and landmarks are from the truth."""
    start, landmarks, observations = tables(spark)
    poses, points = truth()
    result = solver.optimize(start, landmarks, observations, K, solver.Options(prior_weight=10.0, depth_weight=10.0))
    rows = [("pose", c, round(float(np.linalg.norm(lie.se3_log(np.linalg.inv(poses[c]) @ p))), 4)) for c, p in result.poses.items()]
    rows += [("landmark", r.landmark_id, round(float(np.linalg.norm(np.array([r.x, r.y, r.z]) - points[r.landmark_id])), 4)) for r in result.landmarks.collect()]
    return spark.createDataFrame(rows, "kind string, id int, error double")


#: the table scene's cameras stand along x and turn about y
TURN, STEP, SHAKE = 0.02, 0.3, 0.02


def table_poses(n: int = 10) -> dict[int, np.ndarray]:
    poses = {}
    for c in range(n):
        poses[c] = lie.se3_exp(np.array([(c - 4.5) * STEP, 0.05 * (c % 3), 0.1 * (c % 2), 0.0, (c - 4.5) * TURN, 0.0]))
    return poses


def from_tables(orders: DataFrame, lines: DataFrame) -> tuple[dict[int, np.ndarray], DataFrame, DataFrame]:
    """(disturbed poses, disturbed landmarks, exact observations): an order is a landmark, seen by the cameras of its
    lines' suppliers (the last digit) in front of which it stands."""
    key = F.col("o_orderkey")
    part = lambda a, n: (key * a % n) / F.lit(float(n))
    points = orders.select(key.alias("landmark_id"), (6 * part(7919, 1009) - 3).alias("x"), (4 * part(104729, 997) - 2).alias("y"), (5 + 4 * part(1299709, 991)).alias("z"))
    poses = table_poses()
    table = orders.sparkSession.createDataFrame([(c, *map(float, (*lie.quaternion(p[:3, :3]), *p[:3, 3]))) for c, p in poses.items()], "camera_id int, qx double, qy double, qz double, qw double, tx double, ty double, tz double")
    seen = lines.select(F.col("l_orderkey").alias("landmark_id"), (F.col("l_suppkey") % 10).cast("int").alias("camera_id")).distinct()
    at = seen.join(points, "landmark_id").join(F.broadcast(table), "camera_id")
    placed = at.select("landmark_id", "camera_id", act(F.struct("qx", "qy", "qz", "qw", "tx", "ty", "tz"), vec(F.col("x"), F.col("y"), F.col("z"))).alias("p")).where("p.z > 1")
    u, v = project(K, F.col("p"))
    observations = placed.select("landmark_id", "camera_id", u.alias("px"), v.alias("py"), F.col("p.z").alias("depth"))
    start = start_poses()
    landmarks = points.select("landmark_id", (F.col("x") + 0.05).alias("x"), (F.col("y") - 0.05).alias("y"), (F.col("z") + 0.1).alias("z"))
    return start, landmarks, observations


OPTIONS = solver.Options(prior_weight=0.01, depth_weight=1.0, iterations=15, tolerance=1e-8)


def solved_tables(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """(camera_id, qy, tx, ty, tz): each refined pose in the first camera's frame."""
    start, landmarks, observations = from_tables(orders, lines)
    got = solver.optimize(start, landmarks, observations, K, OPTIONS).poses
    rows = []
    for c, m in got.items():
        own = m @ np.linalg.inv(got[0])
        rows.append((c, *(round(float(v), 3) + 0.0 for v in (lie.quaternion(own[:3, :3])[1], *own[:3, 3]))))
    return orders.sparkSession.createDataFrame(rows, "camera_id int, qy double, tx double, ty double, tz double")


def table_residuals(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Residual blocks of the table scene at its disturbed start."""
    start, landmarks, observations = from_tables(orders, lines)
    return solver.residuals(landmarks, observations, start, K, OPTIONS)


def alternated_tables(orders: DataFrame, lines: DataFrame, rounds: int = 2) -> DataFrame:
    """(round, fell, nearer): whether the alternation over the table scene lowers the costs in each round, and whether its
    poses end nearer to the true ones. The points are a cloud of patches, from which depth is rendered."""
    from ..config import Config
    from .reconstruct import poses_of, refine, with_poses

    spark = orders.sparkSession
    start, landmarks, observations = from_tables(orders, lines)
    true = table_poses()
    start = {c: lie.se3_exp(0.1 * lie.se3_log(start[c] @ np.linalg.inv(true[c]))) @ true[c] if c else true[c] for c in true}
    points = landmarks.select(F.lit(0).alias("lidar_id"), (F.col("x") - 0.05).alias("x"), (F.col("y") + 0.05).alias("y"), (F.col("z") - 0.1).alias("z"))
    corner = F.explode(F.array(*[F.struct(F.lit(i * 0.012).alias("a"), F.lit(j * 0.012).alias("b")) for i in range(-1, 2) for j in range(-1, 2)]))
    cloud = points.withColumn("o", corner).select("lidar_id", (F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y"), "z")
    frames = with_poses(spark.createDataFrame([(c, 0) for c in start], "camera_id int, matched_lidar_id int"), start, "initial_pose")
    keys = with_poses(spark.createDataFrame([(0,)], "camera_id int"), {0: np.eye(4)}, "pose").withColumnRenamed("camera_id", "lidar_id")
    seen = observations.select("landmark_id", "camera_id", F.lit(0).alias("kp_idx"), "px", "py").where(f"px >= 0 and px < {K.width} and py >= 0 and py < {K.height}")
    config = Config(num_iteration=rounds, landmark_reprojection_error_threshold=12.0)
    done = refine(frames, keys, cloud, seen, K, config, solver.Options(prior_weight=1.0, depth_weight=0.5, iterations=4), half=0)
    after = poses_of(done.frames, "optimized_pose")
    turn = lambda own, c: own[c] @ np.linalg.inv(own[0])
    far = lambda own: sum(np.linalg.norm(lie.se3_log(np.linalg.inv(turn(true, c)) @ turn(own, c))) for c in true)
    rows = [(n, bool(b < a), bool(far(after) < far(start))) for n, (a, b) in enumerate(zip(done.starts, done.costs, strict=True))]
    return spark.createDataFrame(rows, "round int, fell boolean, nearer boolean")


def start_sql(name: str, poses: dict[int, np.ndarray]) -> str:
    """Poses as a CTE (camera_id, r00 .. r22, t0 .. t2) of DuckDB."""
    rows = ", ".join(f"({c}, {', '.join(f'{float(v)!r}::DOUBLE' for v in (*m[:3, :3].ravel(), *m[:3, 3]))})" for c, m in poses.items())
    return f"{name}(camera_id, {', '.join(f'r{i}{j}' for i in range(3) for j in range(3))}, t0, t1, t2) AS (VALUES {rows})"


def start_poses() -> dict[int, np.ndarray]:
    return {c: lie.se3_exp(SHAKE * np.sin(np.arange(6) * 1.7 + c)) @ p for c, p in table_poses().items()}
