"""Z-buffering: the least depth of the points that fall on each pixel of each camera.

Clouds may be stored as blocks: up to BLOCK points of a scan that are neighbours in Morton order, with their bounding
box. A block meets a camera only if its box may reach into the camera's view, so points that no camera can see are never
joined or moved.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .components import save

HALF_WINDOW = 50
BLOCK = 512  # points of a block at most
CELL = 0.25  # side of the cubes that Morton codes number


def lidar_window(frames: DataFrame, half: int = HALF_WINDOW) -> DataFrame:
    """(camera_id, lidar_id) for the ids around each frame's matched one, from 0 on; frames without one have none."""
    ids = F.sequence(F.greatest(F.lit(0), F.col("matched_lidar_id") - half).cast("int"), (F.col("matched_lidar_id") + half).cast("int"))
    return frames.where("matched_lidar_id is not null and matched_lidar_id + %d >= 0" % half).select("camera_id", F.explode(ids).alias("lidar_id"))


def required_ids(frames: DataFrame, half: int = HALF_WINDOW) -> DataFrame:
    """The distinct ids that any frame needs: point files are read for these alone."""
    return lidar_window(frames, half).select("lidar_id").distinct()


def visible(points: DataFrame, k: G.Intrinsics, point: Column) -> DataFrame:
    """Adds u, v (pixels) and depth (float) of points in camera coordinates, without those behind or outside."""
    u, v = G.project(k, point)
    others = [c for c in points.columns if c not in ("u", "v", "depth")]
    # rows from lists of one: place and pixel are computed once each, in methods that the JVM still compiles, and the
    # filter stays above them, else each of its uses would compute them anew
    placed = points.select(*others, F.inline(F.array(F.struct(u.alias("__u"), v.alias("__v"), F.when(point.z > 0, point.z).alias("__z")))))
    own = F.struct(G.pixel(F.col("__u"), k.width).alias("u"), G.pixel(F.col("__v"), k.height).alias("v"), F.col("__z").cast("float").alias("depth"))
    return placed.select(*others, F.inline(F.array(own))).where("u is not null and v is not null")


def nearest(hits: DataFrame) -> DataFrame:
    """(camera_id, v, u, depth): the least depth of each cell; absent cells are empty."""
    return hits.groupBy("camera_id", "v", "u").agg(F.min("depth").alias("depth"))


def accumulate(before: DataFrame | None, now: DataFrame) -> DataFrame:
    """The running minimum over calls: a buffer isn't cleared between them."""
    return now if before is None else nearest(before.select("camera_id", "v", "u", "depth").unionByName(now.select("camera_id", "v", "u", "depth")))


def morton(x: Column, y: Column, z: Column, cell: float = CELL) -> Column:
    """The place of a point's cube on the Z-shaped curve: 20 bits of each coordinate, interleaved."""

    def spread(v: Column) -> Column:
        v = (F.least(F.greatest(F.floor(v / cell), F.lit(-(1 << 19))), F.lit((1 << 19) - 1)) + (1 << 19)).cast("long")
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


def blocks(points: DataFrame, size: int = BLOCK, cell: float = CELL) -> DataFrame:
    """(lidar_id, n, xs, ys, zs, cx, cy, cz, radius): points (lidar_id, x, y, z) in blocks of neighbours, each with the
    sphere around its bounding box. Scans of any size and density are cut into blocks of bounded size; points with a null
    or NaN are left out, as no camera sees them."""
    kind = dict(points.dtypes)["lidar_id"]
    own = points.select("lidar_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).where("x is not null and y is not null and z is not null and not isnan(x) and not isnan(y) and not isnan(z)")
    coded = own.withColumn("__code", morton(F.col("x"), F.col("y"), F.col("z"), cell))
    order = ["lidar_id", "__code", "x", "y", "z"]
    placed = coded.repartitionByRange(*order).sortWithinPartitions(*order).select("lidar_id", "x", "y", "z")

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("lidar_id")
            new = np.flatnonzero(np.concatenate(([True], ids.slice(1).to_numpy(zero_copy_only=False) != ids.slice(0, batch.num_rows - 1).to_numpy(zero_copy_only=False))))
            starts = np.concatenate([np.arange(a, b, size) for a, b in zip(new, [*new[1:], batch.num_rows], strict=True)])
            offsets = pa.array([*starts, batch.num_rows], pa.int32())
            values = [batch.column(c).to_numpy() for c in "xyz"]
            low, high = ([f(v, starts) for v in values] for f in (np.minimum.reduceat, np.maximum.reduceat))
            radius = np.sqrt(sum((h - l) ** 2 for l, h in zip(low, high, strict=True))) / 2
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]
            centres = [pa.array((l + h) / 2) for l, h in zip(low, high, strict=True)]
            yield pa.record_batch([ids.take(pa.array(starts)), pa.array(np.diff([*starts, batch.num_rows]).astype(np.int32)), *lists, *centres, pa.array(radius)], ["lidar_id", "n", "xs", "ys", "zs", "cx", "cy", "cz", "radius"])

    return placed.mapInArrow(cut, f"lidar_id {kind}, n int, xs array<double>, ys array<double>, zs array<double>, cx double, cy double, cz double, radius double")


def moved(m: Column, x: Column, y: Column, z: Column) -> Column:
    """A point by a matrix struct (r00 .. r22, tx, ty, tz)."""
    return G.vec(*(m[f"r{i}0"] * x + m[f"r{i}1"] * y + m[f"r{i}2"] * z + m[t] for i, t in enumerate(("tx", "ty", "tz"))))


def may_see(k: G.Intrinsics, p: Column, radius: Column) -> Column:
    """Whether a sphere around p, in camera coordinates, may reach into the view: the half spaces before the camera and
    within the borders of the image, half a pixel out. Never false for a sphere with a visible point."""
    slack = radius * (1 + 1e-9) + 1e-6
    sides = [p.z + slack > 0]
    for f, c, n, q in ((k.fx, k.cx, k.width, p.x), (k.fy, k.cy, k.height, p.y)):
        low, high = c + 0.5, n - 0.5 - c
        sides.append(f * q + low * p.z + slack * math.hypot(f, low) >= 0)
        sides.append(high * p.z - f * q + slack * math.hypot(f, high) >= 0)
    out = sides[0]
    for s in sides[1:]:
        out = out & s
    return out


def camera_scans(frames: DataFrame, keyframes: DataFrame, pose: str, half: int) -> DataFrame:
    """(camera_id, lidar_id, m): each frame's scans, and the matrix from scan to camera: poses are composed here, once for
    each pair, and not for each point. Written, else the optimizer copies a matrix's expressions into each use of it."""
    pairs = lidar_window(frames, half).join(frames.select("camera_id", F.col(pose).alias("__cw")), "camera_id").join(keyframes.select("lidar_id", F.col("pose").alias("__wl")), "lidar_id")
    composed = pairs.select("camera_id", "lidar_id", G.let(F.col("__cw"), lambda p: G.compose(p, F.col("__wl"))).alias("__cl"))
    turned = [G.rotate(F.col("__cl"), G.vec(*(F.lit(float(i == j)) for i in range(3)))) for j in range(3)]
    return save(composed.select("camera_id", "lidar_id", F.struct(*[turned[j][c].alias(f"r{i}{j}") for i, c in enumerate("xyz") for j in range(3)], *[F.col(f"__cl.{t}").alias(t) for t in ("tx", "ty", "tz")]).alias("m")))


def seen_blocks(frames: DataFrame, keyframes: DataFrame, clouds: DataFrame, k: G.Intrinsics, pose: str = "initial_pose", half: int = HALF_WINDOW) -> DataFrame:
    """The pairs of camera and block (camera_id, m, and the block's columns) in which a point may be seen: the test is part
    of the join's condition, so a block that fails it makes no row."""
    pairs = camera_scans(frames, keyframes, pose, half).withColumnRenamed("lidar_id", "__of")
    centre = moved(F.col("m"), F.col("cx"), F.col("cy"), F.col("cz"))
    return clouds.join(pairs, (F.col("lidar_id") == F.col("__of")) & may_see(k, centre, F.col("radius"))).drop("__of")


def depth_maps(frames: DataFrame, keyframes: DataFrame, points: DataFrame, k: G.Intrinsics, pose: str = "initial_pose", half: int = HALF_WINDOW, before: DataFrame | None = None, reset: bool = False) -> DataFrame:
    """Depth cells of all frames from the point clouds around their matched keyframes.

    frames: (camera_id, matched_lidar_id, pose); keyframes: (lidar_id, pose); points: (lidar_id, x, y, z), partitioned by
    lidar_id for pruning, or their `blocks`. One rigid transform per point: poses are composed for each (camera,
    keyframe) first, and of blocks only those that the camera may see are taken apart.
    """
    if "radius" in points.columns:
        kept = seen_blocks(frames, keyframes, points, k, pose, half).select("camera_id", "m", F.explode(F.arrays_zip("xs", "ys", "zs")).alias("p"))
        at = kept.select("camera_id", moved(F.col("m"), F.col("p.xs"), F.col("p.ys"), F.col("p.zs")).alias("__p"))
    else:
        at = points.join(camera_scans(frames, keyframes, pose, half), "lidar_id").select("camera_id", moved(F.col("m"), F.col("x"), F.col("y"), F.col("z")).alias("__p"))
    cells = nearest(visible(at, k, F.col("__p")))
    return cells if reset else accumulate(before, cells)


def observation_depth(observations: DataFrame, depth: DataFrame, k: G.Intrinsics, column: str = "depth") -> DataFrame:
    """Observations with `column` from the depth cell under their pixel (px, py); where there is none, or outside the
    image, the previous value stays."""
    cells = depth.where("depth > 0").select("camera_id", F.col("u").alias("__u"), F.col("v").alias("__v"), F.col("depth").cast("double").alias("__depth"))
    keyed = observations.withColumns({"__u": G.pixel(F.col("px"), k.width), "__v": G.pixel(F.col("py"), k.height)})
    old = F.col(column) if column in observations.columns else F.lit(None).cast("double")
    return keyed.join(cells, ["camera_id", "__u", "__v"], "left").withColumn(column, F.coalesce("__depth", old)).select(*observations.columns, *([] if column in observations.columns else [column]))
