"""Joint refinement of poses and points: Levenberg-Marquardt with the points eliminated (Schur complement).

Observations are packed once, in chunks of whole landmarks, as a table bucketed by chunk; the points' coordinates are a
table of their own, 24 bytes a landmark, and the only one that a step writes. A step is one pass over both: it moves the
points, sums costs, and sums what the next reduced system needs for each camera. Poses are world to camera; a step
multiplies them from the left.

The reduced system is solved by conjugate gradients. Beyond EXPLICIT cameras no block of two cameras is ever made: the
product with a vector is a pass over the chunks, in which the cameras' vector goes out to the landmarks (E' p), through
their inverted blocks, and back (E y). The driver holds vectors and one 6 x 6 block for each camera, so its memory is
linear in cameras, however many of them share landmarks. Up to EXPLICIT cameras one dense matrix of fixed bound is summed
in place of the products.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lie
from ..functions.geometry import Intrinsics
from .components import Scratch, save

SE3 = lie.GROUPS["se3"]
EXPLICIT = 64  # cameras whose reduced matrix is summed whole: 1.2 MB
CHUNK = 1 << 15  # observations of a chunk, if a landmark has no more
BLOCK = 256  # cameras whose sums are kept together
WIDE = 36 + 36 + 6 + 6  # sums of a camera: its block, its block less what its own points take, right side, diagonal


@dataclass(frozen=True)
class Options:
    prior_weight: float = 50.0
    depth_weight: float = 0.5
    huber: float = 1.0
    iterations: int = 50
    tolerance: float = 1e-6
    explicit: int = EXPLICIT
    inner: float = 1e-2  # how far conjugate gradients reduce the residual where products are passes
    products: int = 100  # of one step, at most
    chunk: int = CHUNK


@dataclass
class Result:
    poses: dict[int, np.ndarray]
    landmarks: DataFrame
    costs: list[float] = field(default_factory=list)
    breakdown: dict[str, tuple[float, float]] = field(default_factory=dict)
    steps: list[tuple[int, float, float, bool]] = field(default_factory=list)  # number, cost, damping, whether it was taken
    products: int = 0  # passes for products with the reduced system

    def stats(self, spark) -> DataFrame:
        """(step, cost, damping, taken): one row for each step that was tried."""
        return spark.createDataFrame(self.steps, "step int, cost double, damping double, taken boolean")


def robust(r: np.ndarray, delta: float) -> tuple[float, float]:
    """(cost, weight of residual and Jacobian) of a residual block under Huber's loss."""
    s = float(r @ r)
    if s <= delta * delta:
        return 0.5 * s, 1.0
    root = np.sqrt(s)
    return 0.5 * (2 * delta * root - delta * delta), np.sqrt(delta / root)


def blocks(pose: np.ndarray, x: np.ndarray, px: float, py: float, depth: float | None, k: Intrinsics, o: Options):
    """(name, residual, Jacobian by the pose, Jacobian by the point) of one observation."""
    p = pose[:3, :3] @ x + pose[:3, 3]
    by_pose = np.c_[np.eye(3), -lie.skew(p)]
    rotation = pose[:3, :3]
    z = p[2]
    jp = np.array([[k.fx / z, 0, -k.fx * p[0] / z**2], [0, k.fy / z, -k.fy * p[1] / z**2]])
    yield "reprojection", np.array([k.fx * p[0] / z + k.cx - px, k.fy * p[1] / z + k.cy - py]), jp @ by_pose, jp @ rotation
    if depth is not None and depth > 0:
        yield "depth", np.array([o.depth_weight * (z - depth)]), o.depth_weight * by_pose[2:3], o.depth_weight * rotation[2:3]


def prior(pose: np.ndarray, anchor: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """(residual, Jacobian) that hold a pose near its anchor."""
    e = lie.se3_log(np.linalg.inv(anchor) @ pose)
    return o.prior_weight * e, o.prior_weight * SE3.left_jacobian_inverse(-e) @ SE3.adjoint(np.linalg.inv(pose))


def pack(landmarks: DataFrame, observations: DataFrame, cameras: list[int]) -> DataFrame:
    """One row per landmark (landmark_id, x, y, z, and arrays of its observations' columns); observations of unknown
    cameras are left out, and an unknown depth is NaN."""
    known = observations.where(F.col("camera_id").isin(cameras)) if len(cameras) < 1000 else observations.join(F.broadcast(observations.sparkSession.createDataFrame([(c,) for c in cameras], "camera_id int")), "camera_id")
    lists = known.groupBy("landmark_id").agg(F.array_sort(F.collect_list(F.struct("camera_id", "px", "py", "depth"))).alias("obs"))
    met = landmarks.join(lists, "landmark_id", "left").select("landmark_id", "x", "y", "z", F.coalesce("obs", F.array().cast("array<struct<camera_id:int,px:double,py:double,depth:double>>")).alias("obs"))
    depth = F.transform("obs", lambda o: F.coalesce(o["depth"], F.lit(float("nan"))))
    return met.select("landmark_id", "x", "y", "z", *[F.col(f"obs.{c}").alias(c) for c in ("camera_id", "px", "py")], depth.alias("depth"))


class _Blocks:
    """Residuals and normal-equation blocks of a batch of landmarks, one entry for each observation."""

    def __init__(self, owner: np.ndarray, x: np.ndarray, obs: dict[str, np.ndarray], rotations: np.ndarray, shifts: np.ndarray, k: Intrinsics, o: Options):
        c = obs["place"]
        r, n = rotations[c], len(owner)
        p = np.einsum("nij,nj->ni", r, x[owner]) + shifts[c]
        z = p[:, 2]
        by_pose = np.zeros((n, 3, 6))
        by_pose[:, [0, 1, 2], [0, 1, 2]] = 1
        by_pose[:, 0, 4], by_pose[:, 0, 5], by_pose[:, 1, 3] = z, -p[:, 1], -z
        by_pose[:, 1, 5], by_pose[:, 2, 3], by_pose[:, 2, 4] = p[:, 0], p[:, 1], -p[:, 0]
        pinhole = np.zeros((n, 2, 3))
        pinhole[:, 0, 0], pinhole[:, 0, 2] = k.fx / z, -k.fx * p[:, 0] / z**2
        pinhole[:, 1, 1], pinhole[:, 1, 2] = k.fy / z, -k.fy * p[:, 1] / z**2
        pixel = np.stack((k.fx * p[:, 0] / z + k.cx - obs["px"], k.fy * p[:, 1] / z + k.cy - obs["py"]), axis=1)
        has = np.nan_to_num(obs["depth"], nan=0.0) > 0
        deep = np.where(has, o.depth_weight * (z - np.where(has, obs["depth"], z)), 0.0)
        cost_a, wa = self._robust((pixel**2).sum(1), o.huber)
        cost_b, wb = self._robust(deep**2, o.huber)
        self.costs = float(cost_a.sum()), float(cost_b.sum())
        wb = np.where(has, wb * o.depth_weight, 0.0)
        res = np.concatenate((pixel * wa[:, None], (deep * np.where(has, wb / o.depth_weight, 0.0))[:, None]), axis=1)
        first = np.concatenate((pinhole, np.zeros((n, 1, 3))), axis=1) * wa[:, None, None]
        first[:, 2, 2] = wb
        jc, jl = first @ by_pose, first @ r
        turn = lambda m: m.transpose(0, 2, 1)
        self.hcc, self.hcl, self.bc = turn(jc) @ jc, turn(jc) @ jl, np.einsum("nij,ni->nj", jc, res)
        self.hll, self.bl = np.zeros((len(x), 3, 3)), np.zeros((len(x), 3))
        np.add.at(self.hll, owner, turn(jl) @ jl)
        np.add.at(self.bl, owner, np.einsum("nij,ni->nj", jl, res))
        self.owner, self.place = owner, c

    @staticmethod
    def _robust(s: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray]:
        root = np.sqrt(np.maximum(s, 1e-300))
        far = s > delta * delta
        return np.where(far, 0.5 * (2 * delta * root - delta * delta), 0.5 * s), np.where(far, np.sqrt(delta / root), 1.0)

    def back(self, damping: float) -> np.ndarray:
        """The inverses of the damped point blocks; landmarks without observations have none."""
        h = self.hll.copy()
        i = np.arange(3)
        h[:, i, i] += damping * np.maximum(h[:, i, i], 1e-6)
        seen = np.zeros(len(h), bool)
        seen[self.owner] = True
        h[~seen] = np.eye(3)
        return np.linalg.inv(h)

    def moved(self, x: np.ndarray, step: np.ndarray, damping: float) -> np.ndarray:
        rhs = -self.bl
        np.subtract.at(rhs, self.owner, np.einsum("nij,ni->nj", self.hcl, step[self.place]))
        return x + np.einsum("nij,nj->ni", self.back(damping), rhs)

    def by_camera(self, damping: float) -> np.ndarray:
        """Sums of each observation's camera: WIDE numbers a row."""
        back = self.back(damping)[self.owner]
        lead = self.hcl @ back
        return np.concatenate(
            (self.hcc.reshape(-1, 36), (self.hcc - lead @ self.hcl.transpose(0, 2, 1)).reshape(-1, 36), self.bc - np.einsum("nij,nj->ni", lead, self.bl[self.owner]), np.einsum("nii->ni", self.hcc)), axis=1
        )

    def product(self, p: np.ndarray, damping: float) -> np.ndarray:
        """For each observation, what its point hands back to its camera of the vector p: E L^-1 E' p, by camera."""
        out = np.zeros((len(self.hll), 3))
        np.add.at(out, self.owner, np.einsum("nij,ni->nj", self.hcl, p[self.place]))
        out = np.einsum("nij,nj->ni", self.back(damping), out)
        return np.einsum("nij,nj->ni", self.hcl, out[self.owner])

    def pairs(self, damping: float, cameras: int) -> np.ndarray:
        """The dense sum of E L^-1 E' over all points; a bounded number of points at a time."""
        back, out = self.back(damping), np.zeros((cameras * 6, cameras * 6))
        cut = 1 << 8
        for a in range(0, len(self.hll), cut):
            own = np.flatnonzero((self.owner >= a) & (self.owner < a + cut))
            e = np.zeros((min(cut, len(self.hll) - a), cameras, 6, 3))
            np.add.at(e, (self.owner[own] - a, self.place[own]), self.hcl[own])
            e = e.reshape(len(e), cameras * 6, 3)
            out += np.tensordot(e @ back[a : a + cut], e, axes=((0, 2), (0, 2)))
        return out


POINTS, SUMS, COSTS, DENSE = range(4)
_STATE = "kind int, key long, data binary"
_ROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("data", pa.binary())])


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def _put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up rows of one kind and key, which stand together."""
    last, total = None, None
    for batch in batches:
        for kind, key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(data, float)
            if (kind, key) == last:
                total = total + own
                continue
            if last is not None:
                yield _rows([(*last, total.tobytes())])
            last, total = (kind, key), own
    if last is not None:
        yield _rows([(*last, total.tobytes())])


class _Sums:
    """Sums of rows by camera, in blocks of cameras as far as they are met."""

    def __init__(self, width: int):
        self.width, self.held = width, {}

    def add(self, place: np.ndarray, rows: np.ndarray) -> None:
        cameras, of = np.unique(place, return_inverse=True)
        order = np.argsort(of, kind="stable")
        first = np.concatenate(([0], np.cumsum(np.bincount(of))[:-1])).astype(int)
        own = np.add.reduceat(rows[order], first, axis=0) if len(place) else rows
        for b in np.unique(cameras // BLOCK).tolist():
            inside = cameras // BLOCK == b
            self.held.setdefault(b, np.zeros((BLOCK, self.width)))[cameras[inside] - b * BLOCK] += own[inside]

    def rows(self) -> list[tuple[int, int, bytes]]:
        return [(SUMS, b, x.tobytes()) for b, x in self.held.items()]


class Problem:
    """Observations in chunks (bucketed by chunk, written once) and the ids of their landmarks, in the order of points."""

    def __init__(self, landmarks: DataFrame, observations: DataFrame, cameras: np.ndarray, k: Intrinsics, o: Options, scratch: Scratch):
        self.spark, self.cameras, self.k, self.o, self.scratch = landmarks.sparkSession, cameras, k, o, scratch
        packed = scratch.keep(pack(landmarks, observations, cameras.tolist()))
        kind = dict(packed.dtypes)["landmark_id"]
        names = self.spark.sparkContext.broadcast(cameras)

        def cut(batches):
            from pyspark import TaskContext

            made, held, n = TaskContext.get().partitionId() << 33, [], 0
            for batch in batches:
                sizes = np.diff(batch.column("camera_id").offsets.to_numpy())
                at = 0
                while at < batch.num_rows:
                    room = np.searchsorted(np.cumsum(sizes[at:]), o.chunk - n, "right")
                    to = min(batch.num_rows, at + max(int(room), 0 if held else 1))
                    if to > at:
                        held.append(batch.slice(at, to - at))
                        n += int(sizes[at:to].sum())
                    if to < batch.num_rows:
                        yield chunk(made, held)
                        made, held, n = made + 1, [], 0
                    at = to
            if held:
                yield chunk(made, held)

        def chunk(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = {c: t.column(c).combine_chunks() for c in ("camera_id", "px", "py", "depth")}
            counts = np.diff(lists["camera_id"].offsets.to_numpy())
            flat = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
            values = [
                np.repeat(np.arange(len(counts), dtype=np.int32), counts),
                np.searchsorted(names.value, flat["camera_id"].astype(np.int64)).astype(np.int32),
                *(flat[c].astype(float) for c in ("px", "py", "depth")),
                np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1).astype(float),
            ]
            ids = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column("landmark_id").combine_chunks())
            return pa.record_batch([pa.array([number]), ids, *(pa.array([v.tobytes()], pa.binary()) for v in values)], ["chunk", "ids", "owner", "place", "px", "py", "depth", "xyz"])

        made = scratch.keep(packed.mapInArrow(cut, f"chunk long, ids array<{kind}>, owner binary, place binary, px binary, py binary, depth binary, xyz binary"))
        scratch.drop(packed)
        self.name, buckets = f"observations_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = made.select("chunk", "owner", "place", "px", "py", "depth").repartition(buckets, "chunk")
        rows.write.bucketBy(buckets, "chunk").sortBy("chunk").option("path", f"{scratch.folder}/{self.name}").saveAsTable(self.name)
        self.ids = scratch.keep(made.select("chunk", "ids"))
        self.points = scratch.keep(made.select("chunk", "xyz"))
        scratch.drop(made)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _over(self, work: Callable, given: tuple) -> DataFrame:
        """work(chunk, owner, observations, points, given) over all chunks, then what it returns at the end of a task."""
        shared = self.spark.sparkContext.broadcast(given)

        def run(batches):
            state = work()
            for batch in batches:
                for row in range(batch.num_rows):
                    own = {c: batch.column(c)[row].as_buffer() for c in ("owner", "place", "px", "py", "depth", "xyz")}
                    kinds = {"owner": np.int32, "place": np.int32}
                    a = {c: np.frombuffer(v, kinds.get(c, float)) for c, v in own.items()}
                    obs = {"place": a["place"].astype(np.int64), "px": a["px"], "py": a["py"], "depth": a["depth"]}
                    if (out := state.add(batch.column("chunk")[row].as_py(), a["owner"].astype(np.int64), obs, a["xyz"].reshape(-1, 3), shared.value)) is not None:
                        yield _rows([out])
            if done := state.rows():
                yield _rows(done)

        both = self.spark.table(self.name).join(self.points.hint("shuffle_hash"), "chunk")
        return both.mapInArrow(run, _STATE)

    def collected(self, state: DataFrame, width: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """(rows of `width` sums for each camera, sums of the other kinds): the sums of all tasks."""
        parts = int(np.clip(len(self.cameras) // BLOCK + 1, 1, 64))
        sums = state.where(f"kind <> {POINTS}").repartition(parts, "kind", "key").sortWithinPartitions("kind", "key").mapInArrow(_put, _STATE)
        out, more = np.zeros(((len(self.cameras) // BLOCK + 1) * BLOCK, width)), {}
        for r in sums.collect():
            data = np.frombuffer(bytes(r.data), float)
            if r.kind == SUMS:
                out[r.key * BLOCK : (r.key + 1) * BLOCK] = data.reshape(BLOCK, width)
            else:
                more[r.kind] = data
        return out[: len(self.cameras)], more

    def linearize(self, poses: np.ndarray, damping: float, moved: tuple | None = None) -> DataFrame:
        """The state at poses: costs, sums of cameras, and, with `moved` (poses before, step, damping of the step), new points."""
        dense, k, o = len(self.cameras) <= self.o.explicit, self.k, self.o

        class Pass:
            def __init__(self):
                self.sums, self.costs, self.dense = _Sums(WIDE), np.zeros(2), None

            def add(self, chunk, owner, obs, x, given):
                poses, damping, moved = given
                if moved is not None:
                    before, step, own = moved
                    x = _Blocks(owner, x, obs, before[:, :3, :3], before[:, :3, 3], k, o).moved(x, step, own)
                now = _Blocks(owner, x, obs, poses[:, :3, :3], poses[:, :3, 3], k, o)
                self.costs += now.costs
                self.sums.add(now.place, now.by_camera(damping))
                if dense:
                    own = now.pairs(damping, len(poses))
                    self.dense = own if self.dense is None else self.dense + own
                return None if moved is None else (POINTS, chunk, np.ascontiguousarray(x).tobytes())

            def rows(self):
                return [*self.sums.rows(), (COSTS, 0, self.costs.tobytes()), *([] if self.dense is None else [(DENSE, 0, self.dense.tobytes())])]

        return self._over(Pass, (poses, damping, moved))

    def product(self, poses: np.ndarray, damping: float, p: np.ndarray) -> np.ndarray:
        """E L^-1 E' p, for each camera."""
        k, o = self.k, self.o

        class Product:
            def __init__(self):
                self.sums = _Sums(6)

            def add(self, chunk, owner, obs, x, given):
                poses, damping, p = given
                now = _Blocks(owner, x, obs, poses[:, :3, :3], poses[:, :3, 3], k, o)
                self.sums.add(now.place, now.product(p, damping))

            def rows(self):
                return self.sums.rows()

        return self.collected(self._over(Product, (poses, damping, p)), 6)[0]

    def take(self, state: DataFrame) -> None:
        """The points that a state has moved are the points from now on."""
        self.scratch.drop(self.points)
        self.points = state.where(f"kind = {POINTS}").select(F.col("key").alias("chunk"), F.col("data").alias("xyz"))
        self.points._scratch_path = state._scratch_path

    def landmarks(self) -> DataFrame:
        """(landmark_id, x, y, z)."""

        def unpack(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    ids = batch.column("ids")[row].values
                    x = np.frombuffer(batch.column("xyz")[row].as_buffer(), float).reshape(-1, 3)
                    yield pa.record_batch([ids, *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(3))], ["landmark_id", "x", "y", "z"])

        kind = dict(self.ids.dtypes)["ids"][len("array<") : -1]
        return self.ids.join(self.points, "chunk").select("ids", "xyz").mapInArrow(unpack, f"landmark_id {kind}, x double, y double, z double")


def conjugate_gradients(times: Callable[[np.ndarray], np.ndarray], inverse: np.ndarray, b: np.ndarray, tolerance: float = 1e-10, rounds: int | None = None) -> np.ndarray:
    """x with times(x) = b for a positive operator on rows of 6; `inverse` are the blocks of the preconditioner."""
    x, r = np.zeros_like(b), b.copy()
    z = np.einsum("nij,nj->ni", inverse, r)
    p, rz = z.copy(), float((r * z).sum())
    goal = tolerance * tolerance * rz
    for _ in range(20 * b.size if rounds is None else rounds):
        if rz <= goal:
            break
        ap = times(p)
        bend = float((p * ap).sum())
        if bend <= 0:
            break
        alpha = rz / bend
        x += alpha * p
        r -= alpha * ap
        z = np.einsum("nij,nj->ni", inverse, r)
        was, rz = rz, float((r * z).sum())
        p = z + rz / was * p
    return x


def optimize(poses: dict[int, np.ndarray], landmarks: DataFrame, observations: DataFrame, k: Intrinsics, options: Options = Options(), anchors: dict[int, np.ndarray] | None = None, bootstrap: bool = True) -> Result:
    """The refined poses {camera_id: 4 x 4} and landmarks (landmark_id, x, y, z).

    observations: (landmark_id, camera_id, px, py, depth or null). anchors: what the priors hold the poses to; the
    initial poses at first (bootstrap), later the last refined ones, which are then to be given. No cameras or no
    landmarks is an error. A camera without observations stays; a landmark without known cameras is copied through.
    """
    if not poses or not landmarks.limit(1).count():
        raise ValueError("no cameras or no landmarks to optimise")
    if not bootstrap and anchors is None:
        raise ValueError("the last refined poses are needed")
    o, cameras = options, np.array(sorted(poses))
    now = np.stack([np.array(poses[c], float) for c in cameras.tolist()])
    held = np.stack([np.array((anchors or poses)[c], float) for c in cameras.tolist()])
    scratch = Scratch(landmarks.sparkSession)
    problem = None
    try:
        problem = Problem(landmarks, observations, cameras, k, o, scratch)
        return _descend(problem, now, held, o, scratch)
    finally:
        if problem is not None:
            problem.close()
        scratch.clear()


def _descend(problem: Problem, now: np.ndarray, held: np.ndarray, o: Options, scratch: Scratch) -> Result:
    n, e = len(now), np.arange(6)

    def priors(at: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
        found = [prior(p, a, o) for p, a in zip(at, held, strict=True)]
        return sum(0.5 * float(r @ r) for r, _ in found), found

    def sums_at(state: DataFrame, held_cost: float) -> tuple[dict[str, float], np.ndarray, np.ndarray | None]:
        sums, more = problem.collected(state, WIDE)
        return {"reprojection": float(more[COSTS][0]), "depth": float(more[COSTS][1]), "prior": held_cost}, sums, more.get(DENSE)

    damping = 1e-4
    held_cost, held_blocks = priors(now)
    before, sums, dense = sums_at(problem.linearize(now, damping), held_cost)
    start, result = dict(before), Result({}, problem.ids, [sum(before.values())])
    for number in range(o.iterations):
        lead, precondition = sums[:, :36].reshape(n, 6, 6).copy(), sums[:, 36:72].reshape(n, 6, 6).copy()
        right, diagonal = sums[:, 72:78].copy(), sums[:, 78:84].copy()
        for c, (r, jac) in enumerate(held_blocks):
            own = jac.T @ jac
            lead[c] += own
            precondition[c] += own
            right[c] += jac.T @ r
            diagonal[c] += np.diag(own)
        more = damping * np.maximum(diagonal, 1e-6)
        lead[:, e, e] += more
        precondition[:, e, e] += more

        def times(p: np.ndarray, lead=lead, dense=dense, poses=now, damping=damping) -> np.ndarray:
            if dense is None:
                result.products += 1
                taken = problem.product(poses, damping, p)
            else:
                taken = (dense.reshape(n * 6, n * 6) @ p.ravel()).reshape(n, 6)
            return np.einsum("nij,nj->ni", lead, p) - taken

        step = conjugate_gradients(times, np.linalg.inv(precondition), -right, o.inner if dense is None else 1e-10, o.products if dense is None else None)
        tried = np.stack([lie.se3_exp(s) @ p for s, p in zip(step, now, strict=True)])
        softer = max(damping / 3, 1e-12)
        state = scratch.keep(problem.linearize(tried, softer, (now, step, damping)))
        held_cost, found = priors(tried)
        after, *blocks = sums_at(state, held_cost)
        was, got = sum(before.values()), sum(after.values())
        taken = got < was
        result.steps.append((number, got, damping, taken))
        if taken:
            problem.take(state)
            now, before, damping, held_blocks = tried, after, softer, found
            sums, dense = blocks
            result.costs.append(got)
            if was - got <= o.tolerance * was:
                break
        else:
            scratch.drop(state)
            damping *= 4
            if damping > 1e8:
                break
            _, sums, dense = sums_at(problem.linearize(now, damping), 0.0)
    result.poses = dict(zip(problem.cameras.tolist(), now, strict=True))
    result.landmarks = save(problem.landmarks())
    result.breakdown = {name: (start[name], before[name]) for name in start}
    return result


def residuals(landmarks: DataFrame, observations: DataFrame, poses: dict[int, np.ndarray], k: Intrinsics, o: Options = Options(), anchors: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(block_type, landmark_id, camera_id, square): the squared norm of each residual block, by Columns; priors have a
    camera only. Observations of unknown cameras have none, as have depths that are missing or not positive."""
    from ..functions import geometry as G

    spark, kind = landmarks.sparkSession, dict(landmarks.dtypes)["landmark_id"]
    rows = [(int(c), *map(float, (*lie.quaternion(m[:3, :3]), *m[:3, 3]))) for c, m in poses.items()]
    cameras = spark.createDataFrame(rows, "camera_id int, qx double, qy double, qz double, qw double, tx double, ty double, tz double")
    pose = F.struct(*[c for c in cameras.columns if c != "camera_id"]).alias("__pose")
    met = observations.join(landmarks.select("landmark_id", "x", "y", "z"), "landmark_id").join(cameras.select("camera_id", pose), "camera_id")
    placed = met.withColumn("__p", G.act(F.col("__pose"), G.vec(F.col("x"), F.col("y"), F.col("z"))))
    u, v = k.fx * F.col("__p.x") / F.col("__p.z") + k.cx - F.col("px"), k.fy * F.col("__p.y") / F.col("__p.z") + k.cy - F.col("py")
    deep = o.depth_weight * (F.col("__p.z") - F.col("depth"))
    squares = placed.withColumns({"__u": u, "__v": v, "__d": F.when(F.col("depth") > 0, deep)})
    blocks = F.array(F.struct(F.lit("reprojection").alias("block_type"), (F.col("__u") * F.col("__u") + F.col("__v") * F.col("__v")).alias("square")), F.struct(F.lit("depth").alias("block_type"), (F.col("__d") * F.col("__d")).alias("square")))
    out = squares.select("landmark_id", "camera_id", F.explode(blocks).alias("b")).select("b.block_type", "landmark_id", "camera_id", "b.square").where("square is not null")
    held = [(c, float((r := prior(np.asarray(m), np.asarray((anchors or poses)[c]), o)[0]) @ r)) for c, m in poses.items()]
    priors = spark.createDataFrame(held, "camera_id int, square double").select(F.lit("prior").alias("block_type"), F.lit(None).cast(kind).alias("landmark_id"), "camera_id", "square")
    return out.unionByName(priors)


def cost_breakdown(residuals: DataFrame, delta: float = 1.0) -> DataFrame:
    """(block_type, cost) of residual blocks (block_type, square): half the robust values, summed; priors have no loss."""
    from ..functions.geometry import huber

    value = F.when(F.col("block_type") == "prior", F.col("square")).otherwise(huber(F.col("square"), delta))
    return residuals.groupBy("block_type").agg(F.sum(0.5 * value).alias("cost"))
