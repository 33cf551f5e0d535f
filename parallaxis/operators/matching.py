"""Pairing of cameras, descriptor matching and verification of matches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import Scratch, save


def sequential_pairs(cameras: DataFrame, window_size: int) -> DataFrame:
    """(camera_1, camera_2) of cameras at most window_size places apart in the order of their ids.

    cameras: (camera_id, has_descriptors BOOLEAN): those without descriptors take a place but form no pair. A window
    without a place is an error.
    """
    if window_size <= 0:
        raise ValueError("sequential_match_window_size must be positive: window_size")
    # one row per camera, numbered on one task: camera-sized
    placed = cameras.withColumn("pos", F.row_number().over(Window.orderBy("camera_id")))
    usable = placed.where("has_descriptors").select("camera_id", "pos")
    reach = usable.select(F.col("camera_id").alias("camera_1"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + window_size)).alias("pos"))
    return reach.join(usable.withColumnRenamed("camera_id", "camera_2"), "pos").select("camera_1", "camera_2")


def exhaustive_pairs(cameras: DataFrame) -> DataFrame:
    """All (camera_1, camera_2) with camera_1 < camera_2 and descriptors: every later camera of a numbered list."""
    usable = cameras.where("has_descriptors").select("camera_id").withColumn("pos", F.row_number().over(Window.orderBy("camera_id")))
    last = usable.agg(F.max("pos").alias("last"))
    reach = usable.join(F.broadcast(last)).where("pos < last").select(F.col("camera_id").alias("camera_1"), F.explode(F.sequence(F.col("pos") + 1, F.col("last"))).alias("pos"))
    return reach.join(usable.withColumnRenamed("camera_id", "camera_2"), "pos").select("camera_1", "camera_2")


#: descriptors of a block, blocks of queries that wait together for their candidates, and queries measured at a time
PACKED, TOGETHER, SLICE = 4096, 4, 512


def descriptor_blocks(keypoints: DataFrame) -> DataFrame:
    """(camera_id, place, n, kps, data): keypoints in blocks of at most PACKED neighbours, numbered from 0 by camera; data
    holds the descriptors as bytes. Cameras of any size are cut; written once. Descriptors must have one length."""
    kind = dict(keypoints.dtypes)
    wide = "double" if kind["descriptor"] == "array<double>" else "float" if kind["descriptor"] == "array<float>" else None
    own = keypoints.select("camera_id", "kp_idx", F.col("descriptor").cast(f"array<{wide or 'double'}>").alias("descriptor"))
    order = ["camera_id", "kp_idx"]

    def cut(batches):
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, PACKED):
                batch = whole.slice(at, PACKED)
                ids, lists = batch.column("camera_id"), batch.column("descriptor")
                sizes = pc.list_value_length(lists)
                if sizes.null_count or pc.min_max(sizes)["min"].as_py() != pc.min_max(sizes)["max"].as_py() or lists.flatten().null_count:
                    raise ValueError("descriptors must be there, whole, and of one length")
                new = pc.coalesce(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)), pa.scalar(True)).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.concatenate(([True], new)))
                ends = [*starts[1:], batch.num_rows]
                data = [lists.slice(s, e - s).flatten().to_numpy().tobytes() for s, e in zip(starts, ends, strict=True)]
                kps = pa.ListArray.from_arrays(pa.array([*starts, batch.num_rows], pa.int32()), batch.column("kp_idx"))
                yield pa.record_batch([ids.take(pa.array(starts)), pa.array(range(made, made + len(starts))), pa.array([int(e - s) for s, e in zip(starts, ends, strict=True)], pa.int32()), kps, pa.array(data, pa.binary())], ["camera_id", "block", "n", "kps", "data"])
                made += len(starts)

    placed = own.where("camera_id is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    made = save(placed.mapInArrow(cut, f"camera_id {kind['camera_id']}, block long, n int, kps array<{kind['kp_idx']}>, data binary"))
    # numbered without the data: one row a block
    places = made.select("camera_id", "block", (F.row_number().over(Window.partitionBy("camera_id").orderBy("block")) - 1).alias("place"))
    return made.join(places, ["camera_id", "block"]).select("camera_id", "place", "n", "kps", "data")


class _Nearest:
    """The k nearest so far of some queries (n, width), by distance, then by the lesser keypoint."""

    def __init__(self, x: np.ndarray, k: int):
        self.x, self.k = x, k
        self.square = (x * x).sum(1)
        self.have = np.zeros(len(x), np.int64)
        self.distance, self.kp = np.full((len(x), k), np.inf), np.zeros((len(x), k), np.int64)

    def add(self, y: np.ndarray, kps: np.ndarray) -> None:
        square = (y * y).sum(1)
        for at in range(0, len(self.x), SLICE):
            self._add(slice(at, at + SLICE), y, square, kps)

    def _add(self, own: slice, y: np.ndarray, square: np.ndarray, kps: np.ndarray) -> None:
        x, k, have = self.x[own], self.k, self.have[own]
        with np.errstate(all="ignore"):
            rough = (-2 * x) @ y.T
            rough += square
            # all whose rough square may be below the k-th one's, given the rounding of a product of these sizes
            slack = 64 * np.finfo(float).eps * x.shape[1] * (self.square[own] + np.fmax.reduce(square))
            last = self.distance[own, -1] ** 2
            limit = np.where(have == k, last * (1 + 1e-14) - self.square[own] + slack, np.inf)
            met = ~(rough > limit[:, None])
            if met.sum() > 8 * k * len(x):
                kth = np.partition(rough, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
                met = ~(rough > np.minimum(limit, kth + slack)[:, None])
        row, column = np.nonzero(met)
        if not len(row):
            return
        step = max(1, (1 << 20) // x.shape[1])
        exact = np.concatenate([np.sqrt(((x[row[i : i + step]] - y[column[i : i + step]]) ** 2).sum(1)) for i in range(0, len(row), step)])
        held = np.arange(k) < have[:, None]
        row = np.concatenate([np.nonzero(held)[0], row])
        exact, kp = np.concatenate([self.distance[own][held], exact]), np.concatenate([self.kp[own][held], kps[column]])
        order = np.lexsort((kp, exact, row))
        row, exact, kp = row[order], exact[order], kp[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < k
        self.distance[own][row[best], place[best]], self.kp[own][row[best], place[best]] = exact[best], kp[best]
        self.have[own] = np.minimum(np.bincount(row, minlength=len(x)), k)


def knn(keypoints: DataFrame, pairs: DataFrame, k: int = 2) -> DataFrame:
    """(camera_1, camera_2, kp_1, kp_2, distance, rank): the k nearest descriptors of camera_2 by Euclidean distance.

    Descriptors are packed in blocks. A task holds a few blocks of camera_1 and the k nearest of each of their descriptors,
    while all blocks of camera_2 pass by one at a time, so its memory is bounded whatever cameras hold. The distances of
    two blocks are one matrix product; all that may be among the k nearest by it are measured again exactly. Ties go to the
    lesser kp_2; fewer than k descriptors give a shorter list.
    """
    kind = dict(keypoints.dtypes)
    blocks = descriptor_blocks(keypoints)
    real = np.float32 if kind["descriptor"] == "array<float>" else np.float64
    group = F.expr(f"place div {TOGETHER}").cast("int").alias("group")
    asks = pairs.join(blocks.withColumnRenamed("camera_id", "camera_1"), "camera_1").select("camera_1", "camera_2", group, F.lit(0).alias("side"), "place", "kps", "data")
    groups = blocks.select(F.col("camera_id").alias("camera_1"), group).distinct()
    gives = pairs.join(groups, "camera_1").join(blocks.withColumnRenamed("camera_id", "camera_2"), "camera_2").select("camera_1", "camera_2", "group", F.lit(1).alias("side"), "place", "kps", "data")
    # tasks by work, which is no matter of bytes: some 2**25 distances each, as far as there are groups
    sizes = blocks.groupBy("camera_id").agg(F.sum("n").cast("double").alias("n"), F.expr(f"count(distinct place div {TOGETHER})").alias("groups"))
    one, two = (sizes.select(F.col("camera_id").alias(f"camera_{i}"), F.col("n").alias(f"n_{i}"), F.col("groups").alias(f"groups_{i}")) for i in (1, 2))
    work, some = pairs.join(one, "camera_1").join(two, "camera_2").agg(F.sum(F.col("n_1") * F.col("n_2")), F.sum("groups_1")).first()
    parts = int(np.clip((work or 0) / (1 << 25), 1, 4 * (some or 1)))
    keys = ["camera_1", "camera_2", "group"]

    def found(held: list, best: _Nearest | None) -> pa.RecordBatch | None:
        if best is None:
            return None
        own = np.arange(k) < best.have[:, None]
        n = int(own.sum())
        row, rank = np.nonzero(own)
        kps = pa.concat_arrays([h[2] for h in held])
        columns = [pa.repeat(held[0][0], n), pa.repeat(held[0][1], n), kps.take(pa.array(row)), pa.array(best.kp[own]).cast(kps.type), pa.array(best.distance[own]), pa.array((rank + 1).astype(np.int32))]
        return pa.record_batch(columns, ["camera_1", "camera_2", "kp_1", "kp_2", "distance", "rank"])

    def match(batches):
        now, held, best = None, [], None
        for batch in batches:
            for row in range(batch.num_rows):
                first, second, number, side = (batch.column(c)[row] for c in (*keys, "side"))
                if (key := (first, second, number)) != now:
                    if (out := found(held, best)) is not None:
                        yield out
                    now, held, best = key, [], None
                kps = batch.column("kps")[row].values
                data = np.frombuffer(batch.column("data")[row].as_buffer(), real).reshape(len(kps), -1).astype(np.float64)
                if side.as_py() == 0:
                    held.append((first, second, kps, data))
                    continue
                if best is None:
                    best = _Nearest(np.concatenate([h[3] for h in held]), k)
                best.add(data, kps.to_numpy().astype(np.int64))
        if (out := found(held, best)) is not None:
            yield out

    schema = f"camera_1 {kind['camera_id']}, camera_2 {kind['camera_id']}, kp_1 {kind['kp_idx']}, kp_2 {kind['kp_idx']}, distance double, rank int"
    return asks.unionAll(gives).repartition(parts, *keys).sortWithinPartitions(*keys, "side", "place").mapInArrow(match, schema)


def ratio_test(neighbours: DataFrame, ratio: float, max_distance: float = -1.0, single: bool = True) -> DataFrame:
    """(camera_1, camera_2, kp_1, kp_2, distance) of matches whose best distance is below ratio times the second.

    Two neighbours are needed; with max_distance >= 0 a larger best distance is dropped. single: compare in float32.
    """
    kind = "float" if single else "double"
    best = F.when(F.col("rank") == 1, F.col("distance"))
    both = neighbours.where("rank <= 2").groupBy("camera_1", "camera_2", "kp_1").agg(F.max(best).alias("distance"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second"), F.max(F.when(F.col("rank") == 1, F.col("kp_2"))).alias("kp_2"))
    kept = both.where(F.col("distance").cast(kind) < (F.lit(ratio).cast(kind) * F.col("second").cast(kind)).cast(kind))
    if max_distance >= 0:
        kept = kept.where(F.col("distance") <= max_distance)
    return kept.select("camera_1", "camera_2", "kp_1", "kp_2", "distance")


def gate(matches: DataFrame, least: int, inliers: bool = False) -> DataFrame:
    """Matches of the pairs that have at least so many (inliers: so many with `inlier`)."""
    count = F.sum(F.col("inlier").cast("int")) if inliers else F.count("*")
    enough = matches.groupBy("camera_1", "camera_2").agg(count.alias("__n")).where(F.col("__n") >= least).drop("__n")
    return matches.join(enough, ["camera_1", "camera_2"], "left_semi")


def match_pixels(matches: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Adds the pixels x1, y1, x2, y2 of both sides."""
    side = lambda n: keypoints.select(F.col("camera_id").alias(f"camera_{n}"), F.col("kp_idx").alias(f"kp_{n}"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    return matches.join(side(1), ["camera_1", "kp_1"]).join(side(2), ["camera_2", "kp_2"])


#: hypotheses of the first round (each further round has four times as many as the one before) and most matches of a chunk
FIRST_ROUND, CHUNK = 64, 4096
#: a squared line that is so small against its terms is rounding only
EPIPOLE = 1e-16


def hypotheses_needed(share: float, confidence: float = 0.99) -> int:
    """As many samples of seven as have one without outliers, with this confidence, if so large a share are inliers."""
    return math.ceil(math.log(1 - confidence) / math.log1p(-min(share**7, 1 - 1e-12)))


def samples(hypotheses: np.ndarray, n: int) -> np.ndarray:
    """(len(hypotheses), 7) distinct places below n: Floyd's draws from numbers that are hashed from the hypothesis alone."""
    prime = 2147483647
    out = np.empty((len(hypotheses), 7), np.int64)
    for k in range(7):
        x = (hypotheses.astype(np.int64) * 7 + k + 1) * 16807 % prime
        x = (x * x + 12345) % prime * 48271 % prime
        x = (x * x + 54321) % prime
        top = n - 7 + k
        pick = x % (top + 1)
        out[:, k] = np.where((out[:, :k] == pick[:, None]).any(1), top, pick)
    return out


def seven_point(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fundamental matrices (m, 3, 3) of unit norm through seven correspondences each, and whose they are.

    a, b: (h, 7, 2). The matrices that fit are f + t g; a determinant of zero is a cubic in t with one to three real
    roots. Samples that leave more than two matrices free, or any t (three places that share one place in the other view),
    give none.
    """
    p, q = (np.concatenate([x, np.ones((*x.shape[:2], 1))], 2) for x in (a, b))
    _, size, turned = np.linalg.svd((q[:, :, :, None] * p[:, :, None, :]).reshape(len(a), 7, 9))
    f, g = (turned[:, i].reshape(-1, 3, 3) for i in (7, 8))
    cofactors = lambda m: np.stack([np.cross(m[:, 1], m[:, 2]), np.cross(m[:, 2], m[:, 0]), np.cross(m[:, 0], m[:, 1])], 1)
    cf, cg = cofactors(f), cofactors(g)
    c = np.stack([(cf[:, 0] * f[:, 0]).sum(1), (cf * g).sum((1, 2)), (cg * f).sum((1, 2)), (cg[:, 0] * g[:, 0]).sum(1)], 1)
    # the larger of the two outer coefficients leads
    turn = np.abs(c[:, 0]) > np.abs(c[:, 3])
    c = np.where(turn[:, None], c[:, ::-1], c)
    f, g = np.where(turn[:, None, None], g, f), np.where(turn[:, None, None], f, g)
    with np.errstate(all="ignore"):
        c0, c1, c2 = (c[:, i] / c[:, 3] for i in range(3))
        u, v = c1 - c2 * c2 / 3, 2 * c2**3 / 27 - c2 * c1 / 3 + c0
        square = v * v / 4 + u**3 / 27
        one = np.cbrt(-v / 2 - np.copysign(np.sqrt(np.maximum(square, 0)), v))
        angle = np.arccos(np.clip(1.5 * v / u * np.sqrt(np.maximum(-3 / u, 0)), -1, 1))
        alone = np.stack([np.where(one == 0, 0, one - u / (3 * one)), *[np.full(len(a), np.nan)] * 2], 1)
        three = 2 * np.sqrt(np.maximum(-u / 3, 0))[:, None] * np.cos((angle[:, None] - 2 * np.pi * np.arange(3)) / 3)
        t = np.where((square > 0)[:, None], alone, three) - (c2 / 3)[:, None]
        for _ in range(2):
            slope = (3 * t + 2 * c2[:, None]) * t + c1[:, None]
            t = t - np.where(slope == 0, 0, (((t + c2[:, None]) * t + c1[:, None]) * t + c0[:, None]) / slope)
        models = f[:, None] + t[:, :, None, None] * g[:, None]
        models /= np.linalg.norm(models, axis=(2, 3), keepdims=True)
    good = np.isfinite(models).all((2, 3)) & ((size[:, 6] > 1e-9 * size[:, 0]) & (np.abs(c).max(1) > 1e-9))[:, None]
    return models[good], np.nonzero(good)[0]


def _judge(models: np.ndarray, points: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Number and summed squared distance of the points (x1, y1, x2, y2) within threshold of both epipolar lines, by model.

    A point on an epipole has no line and is not counted."""
    a, b = (np.concatenate([points[:, i : i + 2].T, np.ones((1, len(points)))]) for i in (0, 2))
    inliers, cost = np.zeros(len(models), np.int64), np.zeros(len(models))
    step = max(1, (1 << 20) // max(len(points), 1))
    for at in range(0, len(models), step):
        m = models[at : at + step]
        la, lb = np.swapaxes(m, 1, 2) @ b, m @ a
        e = (lb * b).sum(1) ** 2
        sa, sb = (la[:, :2] ** 2).sum(1), (lb[:, :2] ** 2).sum(1)
        defined = (sa > EPIPOLE * (m[:, :, :2] ** 2).sum((1, 2))[:, None] * (b * b).sum(0)) & (sb > EPIPOLE * (m[:, :2] ** 2).sum((1, 2))[:, None] * (a * a).sum(0))
        far = e / np.maximum(np.minimum(sa, sb), 1e-300)
        own = defined & (far <= threshold * threshold)
        inliers[at : at + step], cost[at : at + step] = own.sum(1), np.where(own, far, 0).sum(1)
    return inliers, cost


def _hypotheses(points: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Models of the numbered hypotheses over a chunk's points, in pixels, and the hypothesis of each."""
    centre, size = points.mean(0), max(float(points.std()), 1e-9)
    frame = [np.array([[1 / size, 0, -c[0] / size], [0, 1 / size, -c[1] / size], [0, 0, 1]]) for c in (centre[:2], centre[2:])]
    drawn = ((points - centre) / size)[samples(numbers, len(points))]
    found, owner = seven_point(drawn[:, :, :2], drawn[:, :, 2:])
    models = frame[1].T @ found @ frame[0]
    return models / np.linalg.norm(models, axis=(1, 2), keepdims=True), numbers[owner]


def _points(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """(n, 4) pixels of each row, from its four lists."""
    lists = [batch.column(c) for c in ("x1", "y1", "x2", "y2")]
    for row in range(batch.num_rows):
        yield np.stack([x[row].values.to_numpy(zero_copy_only=False) for x in lists], 1)


def verify_geometry(matches: DataFrame, threshold: float, confidence: float = 0.99, least_share: float = 0.3, scratch: Scratch | None = None) -> DataFrame:
    """Matches with pixels (x1 .. y2) with `inlier`: whether they fit their pair's fundamental matrix within threshold
    pixels of both epipolar lines.

    The matrix of a pair is the best of many through seven matches each (most inliers, then least squared distance, then
    the earlier hypothesis). Hypotheses come in rounds of 64, 256, ...; a pair leaves once as many were tried as find, with
    this confidence, a matrix that its best share of inliers holds for; a share below least_share counts as least_share,
    which bounds the rounds. Samples are hashed from the number of the hypothesis, so reruns agree.

    A pair of up to CHUNK matches is solved and judged in the task that holds it. The matches of a larger one are dealt to
    chunks; each hypothesis draws within one of them, and its matrices are judged by all chunks.
    Matches of pairs with fewer than eight, or without a pixel or camera, and those on an epipole, are no inliers; repeated matches count each.
    Written tables stay in `scratch` for the result to be read.
    """
    own = scratch or Scratch(matches.sparkSession)
    pair, pixels = ["camera_1", "camera_2"], ["x1", "y1", "x2", "y2"]
    kept = own.keep(matches)
    sound = F.lit(0.0)
    for c in pixels:
        sound += F.col(c).cast("double")
    w = Window.partitionBy(*pair)
    placed = kept.where(sound.isNotNull() & ~F.isnan(sound)).select(*pair, *[F.col(c).cast("double").alias(c) for c in pixels], F.count("*").over(w).alias("n"), (F.row_number().over(w.orderBy("kp_1", "kp_2", *pixels)) - 1).alias("i"))
    chunks = F.ceil(F.col("n") / CHUNK)
    lists = placed.where("n >= 8 and camera_1 is not null and camera_2 is not null").groupBy(*pair, "n", chunks.alias("chunks"), (F.col("i") % chunks).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("i", *pixels))).alias("p"))
    packed = own.keep(lists.select(*pair, "n", "chunks", "chunk", *[F.col(f"p.{c}").alias(c) for c in pixels]))
    wide = bool(packed.where("chunks > 1").take(1))
    keys = ", ".join(f"{c} {dict(matches.dtypes)[c]}" for c in pair)
    schema = f"{keys}, h bigint, k int, model array<double>, inliers bigint, cost double"

    def rows(batch: pa.RecordBatch, at: list[int], found: list[tuple]) -> pa.RecordBatch:
        h, k, model, inliers, cost = (list(x) for x in zip(*found, strict=True)) if found else ([],) * 5
        ids = [batch.column(c).take(pa.array(at, pa.int64())) for c in pair]
        columns = [*ids, pa.array(h, pa.int64()), pa.array(k, pa.int32()), pa.array(model, pa.list_(pa.float64())), pa.array(inliers, pa.int64()), pa.array(cost, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, [*pair, "h", "k", "model", "inliers", "cost"])

    def solve(first: int, last: int):
        def run(batches):
            for batch in batches:
                at, found = [], []
                for row, points in enumerate(_points(batch)):
                    parts, own_part = batch.column("chunks")[row].as_py(), batch.column("chunk")[row].as_py()
                    numbers = np.arange(first, last)
                    numbers, best = numbers[numbers % parts == own_part], None
                    for some in np.array_split(numbers, max(1, len(numbers) // 2048)):
                        models, owner = _hypotheses(points, some)
                        if parts > 1:
                            # the place among its hypothesis' roots
                            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                            at += [row] * len(owner)
                            found += [(int(h), int(k), m.ravel(), None, None) for h, k, m in zip(owner, place, models, strict=True)]
                        elif len(models):
                            inliers, cost = _judge(models, points, threshold)
                            i = np.lexsort((owner, cost, -inliers))[0]
                            now = (-int(inliers[i]), float(cost[i]), int(owner[i]), models[i].ravel())
                            best = now if best is None or now[:3] < best[:3] else best
                    if best:
                        at.append(row)
                        found.append((best[2], 0, best[3], -best[0], best[1]))
                yield rows(batch, at, found)

        return run

    def judge(batches):
        for batch in batches:
            at, found = [], []
            for row, points in enumerate(_points(batch)):
                asked = batch.column("asked")[row].values
                models = asked.field("model").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3)
                counts = zip(asked.field("h").to_pylist(), asked.field("k").to_pylist(), models, *_judge(models, points, threshold), strict=True)
                found += [(h, k, m.ravel(), int(n), float(c)) for h, k, m, n, c in counts]
                at += [row] * len(models)
            yield rows(batch, at, found)

    limit, done, best, active, size = hypotheses_needed(least_share, confidence), 0, None, packed, FIRST_ROUND
    rank = F.struct("inliers", -F.col("cost"), -F.col("h"))
    while done < limit:
        last = min(done + size, limit)
        tried = own.keep(active.mapInArrow(solve(done, last), schema))
        judged = tried.where("inliers is not null")
        if wide:
            # models go in blocks, so that a row stays small
            asked = tried.where("inliers is null").groupBy(*pair, F.expr("h div 512").alias("block")).agg(F.collect_list(F.struct("h", "k", "model")).alias("asked"))
            met = active.where("chunks > 1").join(asked, pair).select(*pair, *pixels, "asked").mapInArrow(judge, schema)
            judged = judged.unionByName(met.groupBy(*pair, "h", "k").agg(F.first("model").alias("model"), F.sum("inliers").alias("inliers"), F.sum("cost").alias("cost")))
        after = judged if best is None else judged.unionByName(best.select(judged.columns))
        top = after.groupBy(*pair).agg(F.max_by(F.struct("h", "k", "model", "inliers", "cost"), rank).alias("b")).select(*pair, "b.*")
        now = own.keep(top)
        own.drop(tried, best)
        best, done, size = now, last, size * 4
        share = F.greatest(F.col("inliers") / F.col("n"), F.lit(float(least_share)))
        enough = F.ceil(F.lit(math.log(1 - confidence)) / F.log1p(-F.least(F.pow(share, F.lit(7.0)), F.lit(1 - 1e-12))))
        settled = packed.where("chunk = 0").join(best, pair).where(enough <= done).select(*pair)
        active = packed.join(settled, pair, "left_anti")
        if not active.take(1):
            break
    own.drop(packed)
    m = [F.col("model")[i] for i in range(9)]
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in pixels)
    la, lb = (m[0] * x2 + m[3] * y2 + m[6], m[1] * x2 + m[4] * y2 + m[7]), (m[0] * x1 + m[1] * y1 + m[2], m[3] * x1 + m[4] * y1 + m[5])
    e = x2 * lb[0] + y2 * lb[1] + m[6] * x1 + m[7] * y1 + m[8]
    squares = lambda *v: sum((c * c for c in v[1:]), v[0] * v[0])
    sa, sb = squares(*la), squares(*lb)
    defined = (sa > EPIPOLE * squares(*(m[i] for i in (0, 1, 3, 4, 6, 7))) * (squares(x2, y2) + 1)) & (sb > EPIPOLE * squares(*m[:6]) * (squares(x1, y1) + 1))
    fits = ~F.isnan(sound) & defined & (e * e / F.greatest(F.least(sa, sb), F.lit(1e-300)) <= threshold * threshold)
    return kept.join(best.select(*pair, "model"), pair, "left").select(*[kept[c] for c in matches.columns], F.coalesce(fits, F.lit(False)).alias("inlier"))


def match(keypoints: DataFrame, pairs: DataFrame, ratio: float, threshold: float, least: int, max_distance: float = -1.0) -> DataFrame:
    """All ratio matches, with `inlier`, of the pairs with enough matches and then enough inliers. The cheap gate stands
    before the model fitting."""
    tested = gate(ratio_test(knn(keypoints, pairs), ratio, max_distance), least)
    return gate(verify_geometry(match_pixels(tested, keypoints), threshold), least, inliers=True)


def low_inlier_pairs(matches: DataFrame, share: float = 0.25) -> DataFrame:
    """(camera_1, camera_2, n_matches, n_inliers) of pairs with a smaller share of inliers."""
    counts = matches.groupBy("camera_1", "camera_2").agg(F.count("*").alias("n_matches"), F.sum(F.col("inlier").cast("int")).alias("n_inliers"))
    return counts.where(F.col("n_inliers") / F.col("n_matches") < share)


def pair_stats(matches: DataFrame) -> DataFrame:
    """(camera_1, camera_2, n_matches, n_inliers, share) of each pair."""
    counts = matches.groupBy("camera_1", "camera_2").agg(F.count("*").alias("n_matches"), F.sum(F.col("inlier").cast("int")).alias("n_inliers"))
    return counts.withColumn("share", F.col("n_inliers") / F.col("n_matches"))
