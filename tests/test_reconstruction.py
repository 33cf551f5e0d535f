"""The reconstruction operators against fixtures and plain numpy."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.config import REQUIRED, Config
from parallaxis.functions import geometry as G
from parallaxis.functions import lie
from parallaxis.operators import associate, components, matching, solver, tracks, trajectory, triangulate, zbuffer
from parallaxis.plans import catalogue, reconstruct, scene

POSE = reconstruct.POSE


def as_pose(m):
    return tuple(float(x) for x in (*lie.quaternion(m[:3, :3]), *m[:3, 3]))


def as_matrix(p):
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = lie.rotation(np.array([p.qx, p.qy, p.qz, p.qw])), (p.tx, p.ty, p.tz)
    return m


# --- groups -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", list(lie.GROUPS))
def test_group_laws(name):
    g, rng = lie.GROUPS[name], np.random.default_rng(0)
    for _ in range(5):
        x, a, b = rng.uniform(-0.6, 0.6, g.dof), g.sample(rng), g.sample(rng)
        assert np.allclose(g.log(g.exp(x)), x, atol=1e-8)
        assert np.allclose(a @ g.inverse(a), g.identity(), atol=1e-9)
        assert np.allclose(g.vee(g.hat(x)), x)
        assert np.allclose(a @ g.exp(x) @ g.inverse(a), g.exp(g.adjoint(a) @ x), atol=1e-7)
        h = 1e-6
        numeric = np.stack([g.log(g.exp(x + h * e) @ g.inverse(g.exp(x))) / h for e in np.eye(g.dof)], axis=1)
        assert np.allclose(g.left_jacobian(x), numeric, atol=1e-4)
        assert np.allclose(g.interpolate(a, b, 1.0), b, atol=1e-7) and np.allclose(g.interpolate(a, b, 0.0), a)
        p = rng.normal(size=g.space)
        assert np.allclose(g.act(a @ b, p), g.act(a, g.act(b, p)), atol=1e-9)
        n, d = rng.normal(size=g.space), 0.3
        on = -d * n / (n @ n)
        m, e = g.act_plane(a, n, d)
        assert abs(m @ g.act(a, on) + e) < 1e-9
    mean = g.mean([g.exp(v) for v in np.vstack([np.eye(g.dof), -np.eye(g.dof)]) * 0.05])
    assert np.allclose(mean, g.identity(), atol=1e-4)
    controls = [g.exp(np.full(g.dof, 0.1 * i)) for i in range(5)]
    assert np.allclose(g.spline(controls, 0.0, 1.0, 2.0), controls[2], atol=1e-7)


@pytest.mark.parametrize("name", list(lie.GROUPS))
def test_group_parameters_and_derivatives(name):
    g, rng, h = lie.GROUPS[name], np.random.default_rng(2), 1e-6
    for _ in range(5):
        m, x = g.sample(rng), rng.uniform(-0.7, 0.7, g.dof)
        p = g.params(m)
        assert np.allclose(g.from_params(p), m, atol=1e-9) and g.params(m, np.float32).dtype == np.float32
        assert np.allclose(g.dx_exp_x(x), lie.numeric_jacobian(lambda v: g.params(g.exp(v)), x), atol=1e-5)
        near = lambda v, m=m, p=p: (lambda q: q if q @ p >= 0 or g.space == 2 or not g.turns else np.r_[-q[:4], q[4:]])(g.params(m @ g.exp(v)))
        d = g.dx_mul_exp_x_at_0(m)
        assert np.allclose(d, lie.numeric_jacobian(near, np.zeros(g.dof)), atol=1e-5)
        assert np.allclose(g.dx_log_inv_by_x_at(m) @ d, np.eye(g.dof), atol=1e-8)
        assert np.allclose(g.exp(h * np.eye(g.dof)[0]) - g.identity(), h * g.generator(0), atol=1e-9)
        if g.turns:
            assert np.allclose(g.normalize(m + rng.normal(size=m.shape) * 1e-9 * (m != 0)), m, atol=1e-7)
        if g.scales:
            assert g.scale(g.with_scale(m, 1.7)) == pytest.approx(1.7) and np.allclose(g.with_scaled_rotation(g.identity(), m[: g.space, : g.space])[: g.space, : g.space], m[: g.space, : g.space])
        elif g.turns:
            with pytest.raises(ValueError):
                g.with_scale(m, 2.0)
    controls = [g.exp(rng.uniform(-0.4, 0.4, g.dof)) for _ in range(5)]
    for t in (1.0, 1.35, 2.2, 2.9, 3.0):
        value, first, second = g.spline_derivatives(controls, 1.0, 0.5, t)
        if 1.001 < t < 2.999:
            at = lambda s: g.spline(controls, 1.0, 0.5, s)
            assert np.allclose(first, (at(t + 1e-4) - at(t - 1e-4)) / 2e-4, atol=1e-5)
            assert np.allclose(second, (at(t + 1e-3) - 2 * at(t) + at(t - 1e-3)) / 1e-6, atol=1e-3)
        assert np.allclose(value, g.spline(controls, 1.0, 0.5, t))


def test_uniform_rotations():
    """All entries of uniform rotations have mean 0 and mean square 1 / 3."""
    rng = np.random.default_rng(1)
    m = np.stack([lie.GROUPS["so3"].sample(rng) for _ in range(4000)])
    assert np.abs(m.mean(0)).max() < 0.04 and np.abs((m**2).mean(0) - 1 / 3).max() < 0.03
    assert lie.max_metric([1, 2], [1.5, 2]) == 0.5 and lie.squared_norm([3, 4]) == 25 and not lie.zero_like(np.ones(2)).any()
    assert np.allclose(lie.translation2(1, 2, 0.3), lie.GROUPS["se2"].from_params([np.cos(0.3), np.sin(0.3), 1, 2]))


@pytest.mark.parametrize("name", list(lie.GROUPS))
def test_grouped_averages(spark, name):
    from parallaxis.operators.averages import average

    g, rng = lie.GROUPS[name], np.random.default_rng(6)
    sets = {k: [g.sample(rng)] for k in ("a", None)}
    for k, own in sets.items():
        own[:] = [own[0] @ g.exp(rng.uniform(-0.3, 0.3, g.dof)) for _ in range(9 if k else 1)]
    df = spark.createDataFrame([(k, g.params(m).tolist()) for k, own in sets.items() for m in own] + [("a", None)], "k string, params array<double>")
    got = {r.k: g.from_params(r.params) for r in average(df, name, ["k"]).collect()}
    assert np.allclose(got[None], sets[None][0], atol=1e-7) and set(got) == {"a", None}
    if name in ("so3", "rxso3"):
        q = sum(np.outer(x, x) / (x @ x) for x in (g.params(m) for m in sets["a"]))
        scale = np.exp(np.mean([np.log(g.scale(m)) for m in sets["a"]]))
        assert np.allclose(got["a"], lie.rotation(lie.mean_rotation(q)) * scale, atol=1e-7)
    elif name == "r3":
        assert np.allclose(got["a"][:3, 3], np.mean([m[:3, 3] for m in sets["a"]], axis=0))
    else:
        assert np.abs(np.mean([g.log(g.inverse(got["a"]) @ m) for m in sets["a"]], axis=0)).max() < 1e-4
    whole = average(df.where("k = 'a'"), name).collect()
    assert len(whole) == 1 and np.allclose(g.from_params(whole[0].params), got["a"], atol=1e-4)


def test_splines_over_tables(spark):
    from parallaxis.operators.splines import evaluate

    g, rng = lie.GROUPS["se3"], np.random.default_rng(9)
    controls = {k: [g.exp(rng.uniform(-0.4, 0.4, 6)) for _ in range(n)] for k, n in (("a", 5), ("b", 2))}
    c = spark.createDataFrame([(k, i, g.params(m).tolist()) for k, own in controls.items() for i, m in enumerate(own)], "k string, i int, params array<double>")
    times = spark.createDataFrame([(k, t) for k in ("a", "b", "c") for t in (0.9, 1.0, 1.25, 1.5, 2.4, 3.0, 3.1)], "k string, t double")
    for r in evaluate(times, c, "se3", 1.0, 0.5, ["k"]).collect():
        if r.k == "c" or not 1.0 <= r.t <= 1.0 + 0.5 * (len(controls[r.k]) - 1):
            assert r.value is None
            continue
        value, first, second = g.spline_derivatives(controls[r.k], 1.0, 0.5, r.t)
        assert np.allclose(g.from_params(r.value), value, atol=1e-8) and np.allclose(r.first, first.ravel(), atol=1e-6) and np.allclose(r.second, second.ravel(), atol=1e-5)


def test_planes_and_means():
    n, d = np.array([0.0, 0.6, 0.8]), 2.0
    m, e = lie.plane_of_pose(lie.pose_of_plane(n, d))
    assert np.allclose(m, n) and e == pytest.approx(d)
    assert lie.unique_plane(n, -1.0)[1] == 1.0
    qs = [lie.quaternion(lie.so3_exp(np.array([0.1 * s, 0, 0]))) for s in (-1, 1)]
    assert np.allclose(lie.mean_rotation(sum(np.outer(q, q) for q in qs)), [0, 0, 0, 1])
    assert lie.is_orthogonal(np.eye(3)) and lie.is_scaled_orthogonal(2 * np.eye(3)) and not lie.is_orthogonal(2 * np.eye(3))


def test_columns_match_matrices(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.uniform(-1, 1, 6)], as_pose(lie.se3_exp(rng.uniform(-1, 1, 6))), as_pose(lie.se3_exp(rng.uniform(-1, 1, 6)))) for i in range(20)]
    rows.append((20, [0.1, 0.2, 0.3, 0.0, 0.0, 0.0], as_pose(np.eye(4)), as_pose(np.eye(4))))
    df = spark.createDataFrame(rows, f"i int, x array<double>, a {POSE}, b {POSE}")
    a, b = F.col("a"), F.col("b")
    got = df.select("x", "a", "b", G.pose_exp(*[F.col("x")[i] for i in range(6)]).alias("e"), G.pose_log(a).alias("l"), G.compose(a, b).alias("c"), G.inverse(a).alias("v"), G.blend(a, b, F.lit(0.3)).alias("m")).collect()
    for r in got:
        ma, mb = as_matrix(r.a), as_matrix(r.b)
        assert np.allclose(as_matrix(r.e), lie.se3_exp(np.array(r.x)), atol=1e-9)
        assert np.allclose(list(r.l), lie.se3_log(ma), atol=1e-8)
        assert np.allclose(as_matrix(r.c), ma @ mb, atol=1e-9) and np.allclose(as_matrix(r.v), np.linalg.inv(ma), atol=1e-9)
        turn = lie.so3_exp(0.3 * lie.so3_log(ma[:3, :3].T @ mb[:3, :3]))
        assert np.allclose(as_matrix(r.m)[:3, :3], ma[:3, :3] @ turn, atol=1e-8)
        assert np.allclose(as_matrix(r.m)[:3, 3], 0.7 * ma[:3, 3] + 0.3 * mb[:3, 3])


# --- joins ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket", [0.5, 60.0])
def test_asof(spark, bucket):
    keys = spark.createDataFrame([(10.0, 7, 1.0), (12.0, 8, 3.0), (20.0, 9, 11.0)], "ts double, lidar_id int, value double")
    frames = spark.createDataFrame([(i, t + 0.4) for i, t in enumerate([9.0, 10.0, 11.0, 12.0, 25.0])] + [(9, None)], "camera_id int, ts double")
    got = {r.camera_id: r for r in associate.interpolate_value(associate.neighbours(frames, keys, None, 0.4, bucket), "value", "out").collect()}
    assert [got[i].branch for i in range(5)] == ["clamp_first", "clamp_first", "between", "between", "clamp_last"]
    assert [got[i].out for i in range(5)] == pytest.approx([1.0, 1.0, 2.0, 3.0, 11.0])
    assert got[3].prev.lidar_id == 7 and got[3].alpha == 1.0 and got[9].out is None
    one = associate.neighbours(frames, keys.where("lidar_id = 8"), None, 0.4, bucket).where("camera_id < 9").collect()
    assert all((r.prev or r.next).lidar_id == 8 for r in one)
    poses = keys.select("ts", "lidar_id", G.translation_along(F.col("value")).alias("pose"))
    met = associate.associate(frames, poses, G.translation_along(0.0), bucket=bucket)
    assert {r.camera_id: r.matched_lidar_id for r in met.collect()} == {0: 7, 1: 7, 2: 7, 3: 7, 4: 9, 9: None}
    with pytest.raises(ValueError):
        associate.associate(frames, poses.where("false"), G.translation_along(0.0))


def test_pairing(spark):
    cams = spark.createDataFrame([(i, i != 2) for i in range(5)], "camera_id int, has_descriptors boolean")
    pairs = lambda df: sorted((r.camera_1, r.camera_2) for r in df.collect())
    assert pairs(matching.sequential_pairs(cams, 2)) == [(0, 1), (1, 3), (3, 4)]
    assert pairs(matching.sequential_pairs(cams, 99)) == pairs(matching.exhaustive_pairs(cams)) == [(0, 1), (0, 3), (0, 4), (1, 3), (1, 4), (3, 4)]
    with pytest.raises(ValueError, match="window_size"):
        matching.sequential_pairs(cams, 0)


def test_ratio_boundaries(spark):
    rows = [(0, 1, k, 10 * k + r, d, r) for k, ds in enumerate([(3.0, 4.0), (2.9, 4.0), (1.0,), (6.0, 9.0)]) for r, d in enumerate(ds, 1)]
    nn = spark.createDataFrame(rows, "camera_1 int, camera_2 int, kp_1 int, kp_2 int, distance double, rank int")
    kept = lambda *a: sorted(r.kp_1 for r in matching.ratio_test(nn, *a).collect())
    assert kept(0.75) == [1, 3] and kept(0.75, 6.0) == [1, 3] and kept(0.75, 5.9) == [1]


# --- depth ------------------------------------------------------------------------------------------------------------


def test_zbuffer(spark):
    k = G.Intrinsics(10.0, 10.0, 0.0, 0.0, 4, 4)
    pts = [(0, 0.1, 0.1, 1.0), (0, 0.1, 0.1, 0.9), (0, 0.0, 0.0, -1.0), (0, 0.0, 0.0, 0.0), (0, -0.05, 0.0, 1.0), (0, 0.35, 0.0, 1.0), (0, -0.049, 0.349, 1.0)]
    df = spark.createDataFrame(pts, "camera_id int, x double, y double, z double")
    cells = zbuffer.nearest(zbuffer.visible(df, k, F.struct("x", "y", "z")))
    got = {(r.v, r.u): r.depth for r in cells.collect()}
    assert got == {(1, 1): pytest.approx(0.9), (3, 0): 1.0}  # halves round away from zero: -0.5 and 3.5 are outside
    later = zbuffer.accumulate(cells, spark.createDataFrame([(0, 1, 1, 2.0), (0, 2, 2, 5.0)], "camera_id int, v int, u int, depth float"))
    assert {(r.v, r.u): r.depth for r in later.collect()} == {(1, 1): pytest.approx(0.9), (3, 0): 1.0, (2, 2): 5.0}
    frames = spark.createDataFrame([(0, 1), (1, None)], "camera_id int, matched_lidar_id int")
    assert sorted(r.lidar_id for r in zbuffer.lidar_window(frames, 2).collect()) == [0, 1, 2, 3]
    obs = spark.createDataFrame([(1, 0, 1.2, 0.6, 7.0), (2, 0, -3.0, 0.0, 7.0), (3, 5, 1.0, 1.0, 7.0)], "landmark_id int, camera_id int, px double, py double, depth double")
    assert {r.landmark_id: round(r.depth, 5) for r in zbuffer.observation_depth(obs, cells, k).collect()} == {1: 0.9, 2: 7.0, 3: 7.0}


# --- graph ------------------------------------------------------------------------------------------------------------


def test_blocks_that_no_camera_sees_are_not_joined(spark):
    """Depth maps from blocks are those from points, also of points on borders, and most blocks meet few cameras."""
    rng = np.random.default_rng(3)
    k = G.Intrinsics(50.0, 50.0, 32.0, 24.0, 64, 48)
    cloud = [(int(s), *map(float, p)) for s in range(3) for p in np.concatenate((rng.uniform(-20, 20, (1500, 3)), rng.integers(-8, 8, (300, 3)) / 2, np.full((700, 3), 2.0)))]
    cloud += [(1, None, 0.0, 1.0), (2, float("nan"), 0.0, 1.0), (0, 1e9, 0.0, 1e9)]
    points = spark.createDataFrame(cloud, "lidar_id int, x double, y double, z double")
    frames = spark.createDataFrame([(c, c % 4, as_pose(lie.se3_exp(np.array([*rng.uniform(-3, 3, 3), *rng.uniform(-2, 2, 3)]) * (c > 0)))) for c in range(8)], f"camera_id int, matched_lidar_id int, initial_pose {POSE}")
    keys = spark.createDataFrame([(s, as_pose(lie.se3_exp(rng.uniform(-0.5, 0.5, 6) * (s > 0)))) for s in range(3)], f"lidar_id int, pose {POSE}")
    made = zbuffer.blocks(points, 64, 1.0).cache()
    assert made.agg({"n": "sum"}).first()[0] == len(cloud) - 2 and made.agg({"n": "max"}).first()[0] <= 64
    want = sorted(map(tuple, zbuffer.depth_maps(frames, keys, points, k, half=1).collect()))
    got = sorted(map(tuple, zbuffer.depth_maps(frames, keys, made, k, half=1).collect()))
    assert got == want and len(got) > 200
    joined = zbuffer.seen_blocks(frames, keys, made, k, half=1).agg({"n": "sum"}).first()[0]
    pairs = zbuffer.camera_scans(frames, keys, "initial_pose", 1).count()
    assert joined < 0.75 * pairs * len(cloud) / 3, (joined, pairs)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(500, 500), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            p, q = sorted((root(a), root(b)))
            up[q] = p
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


def test_json_records_across_splits(spark, tmp_path):
    """A file of many splits gives what one task would: objects over many lines, several on a line, braces in strings."""
    from parallaxis.sources import readers

    rng = random.Random(3)
    made = [{"id": i, "text": rng.choice(['{"', "}}", "\\\\", 'a"}{"', "plain", ""]) * rng.randrange(4), "deep": {"x": [rng.random()] * rng.randrange(30), "y": {}}} for i in range(400)]
    text = "junk }\n" + "".join(json.dumps(o, indent=rng.choice([None, None, 2])) + rng.choice(["\n", "", " ", "\n\n"]) for o in made) + "\n}\n" + json.dumps({"id": 400})
    (tmp_path / "k.json").write_text(text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("1500", "20000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            records = readers.json_records(spark, str(tmp_path / "k.json")).orderBy("place").collect()
            assert [o for r in records for o in readers.json_objects(r.value)] == [*made, {"id": 400}]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    (tmp_path / "open.json").write_text('{"id": 1}\n{"id": 2,\n')
    with pytest.raises(json.JSONDecodeError):
        [o for r in readers.json_records(spark, str(tmp_path / "open.json")).orderBy("place").collect() for o in readers.json_objects(r.value)]
    (tmp_path / "none.json").write_text("")
    assert readers.json_records(spark, str(tmp_path / "none.json")).count() == 0


def test_components_in_batches(spark, tmp_path, monkeypatch):
    """Any split of the edges gives what the whole gives; a batch that is sent again, or was cut short, changes nothing."""
    from parallaxis.plans.growing import GrowingComponents

    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(500, 500), (None, 7), (900, None), (3, 4), (3, 4)]
    frame = lambda some: spark.createDataFrame(some, "a long, b long")
    read = lambda df: {r.node: r.component for r in df.collect()}
    want = read(components.connected_components(frame(edges)))
    rng.shuffle(edges)
    grown = GrowingComponents(spark, str(tmp_path / "one"))
    assert grown.labels() is None
    cuts = [edges[:30], [], edges[30:50], edges[50:] + edges[:5]]
    for n, some in enumerate(cuts):
        if n == 2:  # cut short before its commit
            with monkeypatch.context() as m:
                m.setattr(grown.rounds, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(RuntimeError):
                    grown.add(frame(some), n)
            assert read(grown.labels()) == read(components.connected_components(frame(edges[:30])))
            grown = GrowingComponents(spark, str(tmp_path / "one"))
        assert grown.add(frame(some), n)
    assert not grown.add(frame([(1, 119)]), 3)
    assert read(GrowingComponents(spark, str(tmp_path / "one")).labels()) == want
    # two large components that meet last: their homes move, no node is written again
    chain = GrowingComponents(spark, str(tmp_path / "two"))
    chain.add(frame([(i, i + 1) for i in range(10, 20)]), 0)
    chain.add(frame([(i, i + 1) for i in range(30, 40)]), 1)
    chain.add(frame([(20, 35), (1, 40)]), 2)
    assert set(read(chain.labels()).values()) == {1} and len(read(chain.labels())) == 23
    assert spark.read.parquet(f"{tmp_path}/two/homes/2").count() == 1


def test_customer_components(spark, tmp_path):
    """Each line of an order is a link, of customers with suppliers and with parts."""
    orders = [(1, 8), (2, 9), (3, 14), (4, 21), (5, 30)]
    lines = [(1, 5, 1), (2, 5, 2), (2, 6, 3), (3, 7, 40), (4, 7, 40), (4, 8, 41), (6, 9, 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    s = 1000000000
    got = {r.node: r.component for r in catalogue.QUERIES["customer_components_whole"](spark, str(tmp_path)).collect()}
    assert got == {8: 8, 9: 8, s + 5: 8, s + 6: 8, 14: 14, 21: 14, s + 7: 14, s + 8: 14}
    parts = {r.node: r.component for r in catalogue.QUERIES["customer_components"](spark, str(tmp_path)).collect()}
    assert parts == {8: 8, s + 1: 8, 9: 9, s + 2: 9, s + 3: 9, 14: 14, 21: 14, s + 40: 14, s + 41: 14}


def test_three_camera_track(spark):
    keypoints = spark.createDataFrame([(0, 0, 100.0, 200.0), (1, 0, 110.0, 205.0), (2, 0, 120.0, 210.0), (1, 1, 5.0, 5.0)], "camera_id int, kp_idx int, x double, y double")
    matches = spark.createDataFrame([(0, 1, 0, 0, True), (0, 2, 0, 0, True), (0, 1, 0, 1, True), (0, 1, 0, 9, True), (1, 2, 1, 7, False)], "camera_1 int, camera_2 int, kp_1 int, kp_2 int, inlier boolean")
    got = tracks.observations(tracks.components(matches), keypoints).orderBy("camera_id").collect()
    assert [(r.landmark_id, r.camera_id, r.kp_idx, r.px, r.py) for r in got] == [(0, 0, 0, 100.0, 200.0), (0, 1, 0, 110.0, 205.0), (0, 2, 0, 120.0, 210.0)]


def _views(rng, n, far=0):
    """Pixels of n points in two views; the first `far` of them are anywhere in the second."""
    x = np.c_[rng.uniform(-2, 2, (n, 2)), rng.uniform(4, 9, n)]
    pose = lie.se3_exp(np.array([0.5, 0.1, 0.0, 0.02, -0.1, 0.05]))
    y = x @ pose[:3, :3].T + pose[:3, 3]
    a, b = (500 * p[:, :2] / p[:, 2:] for p in (x, y))
    b[:far] = rng.uniform(-250, 250, (far, 2))
    return a, b


_MATCHED = "camera_1 int, camera_2 int, kp_1 int, kp_2 int, x1 double, y1 double, x2 double, y2 double"


def test_seven_point():
    """Each model holds its seven correspondences and has no rank to spare; among them is the true one."""
    rng = np.random.default_rng(7)
    a, b = _views(rng, 40)
    picks = matching.samples(np.arange(50), 40)
    assert all(len(set(p)) == 7 for p in picks.tolist()) and picks.min() >= 0 and picks.max() < 40
    assert sorted(map(tuple, np.sort(matching.samples(np.arange(400), 8), 1).tolist()))[0] == tuple(range(7))
    assert len({tuple(sorted(p)) for p in matching.samples(np.arange(400), 8).tolist()}) == 8  # all that can be drawn
    models, owner = matching.seven_point(a[picks] / 300, b[picks] / 300)
    assert set(owner) == set(range(50)) and np.bincount(owner).max() <= 3 and np.allclose(np.linalg.norm(models, axis=(1, 2)), 1)
    one = np.ones((40, 1))
    p, q = np.c_[a / 300, one], np.c_[b / 300, one]
    for m, h in zip(models, owner, strict=True):
        assert np.abs(np.einsum("ni,ij,nj->n", q[picks[h]], m, p[picks[h]])).max() < 1e-9
        assert abs(np.linalg.det(m)) < 1e-9
    whole = [np.abs(np.einsum("ni,ij,nj->n", q, m, p)).max() < 1e-6 for m in models]
    assert {h for h, good in zip(owner, whole, strict=True) if good} >= set(range(45))
    assert not len(matching.seven_point(np.repeat(a[:1], 7, 0)[None], np.repeat(b[:1], 7, 0)[None])[0])  # one point seven times
    hub = picks[:1]
    shared = b[hub].copy()
    shared[0, :3] = shared[0, 0]
    assert not len(matching.seven_point(a[hub] / 300, shared / 300)[0])  # three places meet in one: any matrix of the pencil fits


def test_epipolar_inliers(spark, monkeypatch):
    """A pair with three in four, one with three in ten, one too small, odd rows; then the same in chunks."""
    rng = np.random.default_rng(7)
    rows = []
    for c, n, far in ((1, 60, 15), (2, 200, 140), (3, 7, 0)):
        a, b = _views(rng, n, far)
        rows += [(0, c, i, i, *map(float, (*a[i], *b[i]))) for i in range(n)]
    same = [(0, 4, i, i, 5.0, 5.0, 9.0, 9.0) for i in range(20)]
    odd = [(0, 1, 900, 0, None, 1.0, 1.0, 1.0), (0, 1, 901, 0, float("nan"), 1.0, 1.0, 1.0), (None, 1, 0, 0, 1.0, 1.0, 1.0, 1.0), rows[20]]
    m = spark.createDataFrame(rows + same + odd, _MATCHED).withColumn("n", F.lit("kept"))
    for chunk in (4096, 100):
        monkeypatch.setattr(matching, "CHUNK", chunk)
        got = matching.verify_geometry(m, 1.0)
        assert got.columns == [*m.columns, "inlier"]
        out = got.collect()
        assert len(out) == len(rows) + 24 and all(r.n == "kept" for r in out)
        true = lambda c, lo, hi: sum(r.inlier for r in out if r.camera_1 == 0 and r.camera_2 == c and lo <= r.kp_1 < hi)  # noqa: B023, E731
        assert true(1, 15, 60) == 46 and true(1, 0, 15) <= 3  # one of the 45 is there twice
        assert true(2, 140, 200) == 60 and true(2, 0, 140) <= 10
        assert true(3, 0, 7) == 0 and true(4, 0, 20) == 0 and true(1, 900, 999) == 0
        assert not any(r.inlier for r in out if r.camera_1 is None)
    assert matching.verify_geometry(m.where("false"), 1.0).count() == 0
    one = m.where("camera_2 = 1 and camera_1 = 0")
    first, again = matching.verify_geometry(one, 1.0), matching.verify_geometry(one.repartition(3, "kp_1"), 1.0)
    assert again.exceptAll(first).count() == 0 and matching.gate(first, 40, inliers=True).count() == 63


# --- points and poses -------------------------------------------------------------------------------------------------


def test_geometric_median():
    assert np.allclose(triangulate.geometric_median([[1.0, 2, 3]]), [1, 2, 3])
    assert np.allclose(triangulate.geometric_median([[1.0, 1, 1]] * 3 + [[9.0, 9, 9]]), [1, 1, 1], atol=1e-4)
    assert np.allclose(triangulate.geometric_median([[0.0, 0, 0]] * 2), [0, 0, 0])


def test_pixels_are_rounded_exactly(spark):
    """halves go away from zero, what lies next to them doesn't, and no decimal numbers are made for it."""
    half = [0.5, 1.5, 2.5, 638.5]
    values = [*half, *np.nextafter(half, -np.inf).tolist(), *np.nextafter(half, np.inf).tolist(), -0.5, -0.49999999999999994, -0.0, 0.0, 639.0, 639.5, 1e300, -1e300, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", G.pixel(F.col("x"), 640).alias("p"))
    assert "round(" not in df._jdf.queryExecution().optimizedPlan().toString()
    for r in df.collect():
        inside = r.x is not None and -0.5 < r.x < 639.5
        assert r.p == (None if not inside else max(0, int(np.floor(r.x)) + (r.x - np.floor(r.x) >= 0.5)))


def test_geometric_medians_in_lockstep():
    """groups solved together get what each gets alone, and empty ones nothing."""
    rng = np.random.default_rng(8)
    groups = [rng.normal(size=(n, 3)) for n in (1, 2, 9, 3, 40, 1)] + [np.ones((4, 3)), np.r_[np.zeros((3, 3)), np.ones((1, 3))], np.zeros((0, 3)), np.full((2, 3), np.nan)]
    got = triangulate.geometric_medians(np.concatenate(groups).T, np.array([len(g) for g in groups]))
    for g, m in zip(groups, got.T, strict=True):
        assert np.isnan(m).all() if not len(g) else np.allclose(m, triangulate.geometric_median(g), atol=1e-12, equal_nan=True)


def kernels(df) -> int:
    """Python kernels of a plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def triangulation_of(spark):
    obs = spark.range(40).selectExpr("cast(id div 3 as int) landmark_id", "cast(id % 3 as int) camera_id", "0 kp_idx", "320.0D + id div 3 + 25 * (id % 3) px", "240.0D py", "2.0D depth")
    cams = spark.range(3).select(F.col("id").cast("int").alias("camera_id"), G.pose(0.0, 0.0, 0.0, 1.0, F.col("id") / 10, 0.0, 0.0).alias("pose"))
    return triangulate.triangulate(obs.select("landmark_id").distinct(), obs, cams, scene.K, 8.0)


def test_landmarks_and_observations_place_each_landmark_once(spark):
    """the kernel stands in each plan once, not once for each use of a position."""
    out, kept, _ = triangulation_of(spark)
    assert kernels(out) == 1 and kernels(kept) == 1 and out.count() == 14 - 1


def test_metrics_place_each_landmark_once(spark):
    """all counts come from one pass."""
    metrics = triangulation_of(spark)[2]
    counts = {r.metric: r.value for r in metrics.collect()}
    assert kernels(metrics) == 1 and counts["with_depth"] == 39 and counts["observations"] == 40 and counts["landmarks"] == 14


def test_small_medians_hold_little(spark):
    """groups are cut over batches of rows; no list of a group is made, and keys may be null."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rng = np.random.default_rng(5)
    rows = [(g, *map(float, p)) for g, n in ((None, 9), ("a", 1), ("b", 31), ("c", 4)) for p in rng.normal(size=(n, 3))]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    was = triangulate.CUT
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        triangulate.CUT = 5
        for listed in (100, 8):
            found = triangulate.medians(df, "g", listed)
            assert listed < 100 or "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
            got = {r.g: (r.m.x, r.m.y, r.m.z) for r in found.collect()}
            assert set(got) == {None, "a", "b", "c"}
            assert all(np.allclose(got[g], triangulate.geometric_median(np.array([r[1:] for r in rows if r[0] == g])), atol=1e-8) for g in got)
    finally:
        triangulate.CUT = was
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_medians_of_large_groups(spark):
    """Groups that are no lists: the rounds over partial sums give what the lists give."""
    rng = np.random.default_rng(3)
    rows = [(g, *map(float, p)) for g, n in ((1, 60), (2, 7), (3, 1), (4, 40)) for p in rng.normal(size=(n, 3))] + [(5, 1.0, 1.0, 1.0)] * 30 + [(5, 9.0, 9.0, 9.0)] * 3 + [(6, 0.0, 0.0, 0.0)] * 25
    df = spark.createDataFrame(rows, "g int, x double, y double, z double")
    want = {g: triangulate.geometric_median(np.array([r[1:] for r in rows if r[0] == g])) for g in range(1, 7)}
    for listed in (100, 20, 0):
        got = {r.g: (r.m.x, r.m.y, r.m.z) for r in triangulate.medians(df, "g", listed).collect()}
        assert set(got) == set(want) and all(np.allclose(got[g], want[g], atol=1e-8) for g in want)
    assert triangulate.medians(df.where("false"), "g").count() == 0


def test_row_numbers(spark):
    from parallaxis.operators.ranking import row_numbers

    df = spark.createDataFrame([(v % 37 if v % 5 else None, v) for v in range(300)], "a int, b int").repartition(7)
    got = [(r.a, r.b) for r in row_numbers(df, ["a", "b"]).orderBy("row").collect()]
    assert got == sorted(((v % 37 if v % 5 else None, v) for v in range(300)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [r.row for r in row_numbers(df, ["a", "b"]).orderBy("row").collect()] == list(range(1, 301))
    assert row_numbers(df.where("false"), ["a"]).count() == 0


def test_knn_with_many_ties(spark):
    """More equal descriptors than any shortlist: the least keypoints win."""
    rows = [(0, 0, [1.0, 0.0])] + [(1, i, [0.0, 1.0]) for i in range(40)] + [(1, 40, [0.5, 0.5]), (2, 0, [1.0, 1.0])]
    k = spark.createDataFrame(rows, "camera_id int, kp_idx int, descriptor array<float>")
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "camera_1 int, camera_2 int")
    got = {(r.camera_1, r.kp_1, r["rank"]): r.kp_2 for r in matching.knn(k, pairs, 4).collect()}
    assert [got[0, 0, n] for n in (1, 2, 3, 4)] == [40, 0, 1, 2] and got[1, 7, 1] == 0 and (1, 7, 2) not in got


def test_knn_over_blocks(spark, monkeypatch):
    """cameras cut into blocks that pass one by one give what whole cameras give, ties too."""
    monkeypatch.setattr(matching, "PACKED", 3)
    monkeypatch.setattr(matching, "TOGETHER", 2)
    rng = np.random.default_rng(4)
    rows = [(c, 7 * i, [float(v) for v in rng.integers(0, 3, 4)]) for c, n in ((0, 17), (1, 20), (2, 1), (4, 6)) for i in range(n)]
    k = spark.createDataFrame(rows, "camera_id int, kp_idx int, descriptor array<float>").repartition(3)
    pairs = spark.createDataFrame([(0, 1), (1, 2), (1, 4), (0, 3)], "camera_1 int, camera_2 int")
    got = sorted(tuple(r) for r in matching.knn(k, pairs, 3).collect())
    far = lambda a, b: float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum()))
    want = []
    for one, two in ((0, 1), (1, 2), (1, 4)):
        for _, i, a in (r for r in rows if r[0] == one):
            near = sorted((far(a, b), j) for c, j, b in rows if c == two)[:3]
            want += [(one, two, i, j, d, n + 1) for n, (d, j) in enumerate(near)]
    assert got == sorted(want)
    assert matching.knn(k, pairs.where("false")).count() == 0 and matching.knn(k.where("false"), pairs).count() == 0
    with pytest.raises(Exception, match="one length"):
        matching.knn(k.unionByName(spark.createDataFrame([(0, 500, [1.0])], k.schema)), pairs).count()


#: queries over the matches that have SQL, and the findings on them
MATCHED = ["track_observations", "inlier_components", "low_inlier_pairs", "pair_stats", "inlier_gate", "lowe_ratio_single", "lowe_ratio", "lowe_ratio_capped", "connected_components", "track_length_stats"]


@pytest.mark.parametrize("name", MATCHED)
def test_queries_over_cut_cameras(spark, monkeypatch, name):
    """Queries whose matches come from cameras in many blocks return what their SQL returns."""
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(matching, "PACKED", 16)
    monkeypatch.setattr(matching, "TOGETHER", 2)
    folder = "/root/testdata/sf0.001"
    got = catalogue.QUERIES[name](spark, folder)
    base = duckdb.connect()
    base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = base.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert len(want) and sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_triangulate(spark):
    poses, points = scene.truth()
    cams = spark.createDataFrame([(c, as_pose(p)) for c, p in poses.items()], f"camera_id int, pose {POSE}")
    rows = []
    for i, x in enumerate(points):
        for c, p in poses.items():
            q = p[:3, :3] @ x + p[:3, 3]
            rows.append((i, c, 0, float(500 * q[0] / q[2] + 320), float(500 * q[1] / q[2] + 240), float(q[2])))
    rows[0] = (*rows[0][:3], rows[0][3] + 100, *rows[0][4:])  # an outlier
    rows[3] = (*rows[3][:5], 0.0)
    rows[4] = (*rows[4][:5], -1.0)  # one observation left: the landmark goes
    rows.append((7, 99, 0, 1.0, 1.0, 1.0))
    rows.append((7, 98, 0, 1.0, 1.0, 1.0))  # unknown cameras: untouched
    obs = spark.createDataFrame(rows, "landmark_id int, camera_id int, kp_idx int, px double, py double, depth double")
    out, kept, metrics = triangulate.triangulate(obs.select("landmark_id").distinct(), obs, cams, scene.K, 8.0)
    at = {r.landmark_id: r.initial_position for r in out.collect()}
    assert set(at) == {0, 2, 3, 4, 7} and at[7] is None
    for i in (2, 3, 4):
        assert np.allclose([at[i].x, at[i].y, at[i].z], points[i], atol=1e-5)
    assert {(r.landmark_id, r.camera_id) for r in kept.where("landmark_id = 0").collect()} == {(0, 1), (0, 2)}
    counts = {r.metric: r.value for r in metrics.collect()}
    assert (counts["landmarks_kept"], counts["removed_without_depth"], counts["removed_outliers"], counts["removed_landmarks"]) == (5, 2, 1, 1)


def test_jacobians():
    rng = np.random.default_rng(2)
    pose, anchor, x = lie.se3_exp(rng.uniform(-0.2, 0.2, 6)), lie.se3_exp(rng.uniform(-0.2, 0.2, 6)), np.array([0.3, -0.2, 5.0])
    o = solver.Options()
    for n, (_, _, jp, jx) in enumerate(solver.blocks(pose, x, 300.0, 200.0, 4.8, scene.K, o)):
        own = lambda p, y, n=n: list(solver.blocks(p, y, 300.0, 200.0, 4.8, scene.K, o))[n][1]
        assert np.allclose(jp, lie.numeric_jacobian(lambda d: own(lie.se3_exp(d) @ pose, x), np.zeros(6)), atol=1e-3)
        assert np.allclose(jx, lie.numeric_jacobian(lambda d: own(pose, x + d), np.zeros(3)), atol=1e-3)
    _, j = solver.prior(pose, anchor, o)
    assert np.allclose(j, lie.numeric_jacobian(lambda d: solver.prior(lie.se3_exp(d) @ pose, anchor, o)[0], np.zeros(6)), atol=1e-3)


def test_batch_blocks():
    """The arrays of a batch against one observation after the other, and the reduced system against a dense one."""
    rng, o = np.random.default_rng(11), solver.Options(prior_weight=1.0, depth_weight=0.7)
    poses = [lie.se3_exp(rng.uniform(-0.2, 0.2, 6)) for _ in range(4)]
    x = np.c_[rng.uniform(-1, 1, (5, 2)), rng.uniform(4, 6, 5)]
    rows = [(i, c, *rng.uniform(100, 400, 2), d) for i in range(4) for c, d in zip(rng.permutation([0, 1, 2, 3, 0])[: 2 + i % 3], (4.5, None, 0.0, 5.5, -1.0), strict=False)]
    owner, place = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    obs = {"place": place, "px": np.array([r[2] for r in rows]), "py": np.array([r[3] for r in rows]), "depth": np.array([np.nan if r[4] is None else r[4] for r in rows])}
    got = solver._Blocks(owner, x, obs, np.stack([p[:3, :3] for p in poses]), np.stack([p[:3, 3] for p in poses]), scene.K, o)
    cost = {"reprojection": 0.0, "depth": 0.0}
    h, b = np.zeros((24 + 15, 24 + 15)), np.zeros(24 + 15)
    for i, c, u, v, d in rows:
        for name, r, jc, jl in solver.blocks(poses[c], x[i], u, v, d, scene.K, o):
            own, w = solver.robust(r, o.huber)
            cost[name] += own
            j = np.zeros((len(r), 39))
            j[:, 6 * c : 6 * c + 6], j[:, 24 + 3 * i : 27 + 3 * i] = w * jc, w * jl
            h, b = h + j.T @ j, b + j.T @ (w * r)
    assert got.costs == pytest.approx((cost["reprojection"], cost["depth"]))
    damping = 0.3
    points = h[24:, 24:] + damping * np.diag(np.maximum(np.diag(h[24:, 24:]), 1e-6))
    points[12:, 12:] = np.eye(3)  # a landmark that nobody sees
    back = np.linalg.inv(points)
    want, right = h[:24, :24] - h[:24, 24:] @ back @ h[24:, :24], b[:24] - h[:24, 24:] @ back @ b[24:]
    sums, led = solver._Sums(solver.WIDE), np.zeros((4, 6, 6))
    sums.add(got.place, got.by_camera(damping))
    (_, block, data), = sums.rows()
    rows_of = np.frombuffer(data, float).reshape(solver.BLOCK, solver.WIDE)
    assert block == 0 and not rows_of[4:].any()
    for c in range(4):
        own = slice(6 * c, 6 * c + 6)
        led[c] = rows_of[c, :36].reshape(6, 6)
        assert np.allclose(led[c], h[own, own]) and np.allclose(rows_of[c, 72:78], right[own]) and np.allclose(rows_of[c, 78:], np.diag(h)[own])
    assert np.allclose(got.pairs(damping, 4), h[:24, 24:] @ back @ h[24:, :24])
    p = rng.normal(size=(4, 6))
    taken = np.zeros((4, 6))
    np.add.at(taken, got.place, got.product(p, damping))
    assert np.allclose(taken.ravel(), h[:24, 24:] @ back @ h[24:, :24] @ p.ravel())
    dense = want + np.eye(24) * 5
    times = lambda q: (dense @ q.ravel()).reshape(4, 6)
    assert np.allclose(solver.conjugate_gradients(times, np.stack([np.eye(6)] * 4), right.reshape(-1, 6)).ravel(), np.linalg.solve(dense, right), atol=1e-8)
    step = rng.normal(size=(4, 6)) * 0.01
    assert np.allclose(got.moved(x, step, damping)[:4].ravel(), x[:4].ravel() + (back @ (-b[24:] - h[24:, :24] @ step.ravel()))[:12])


def ring(spark, n, points_n, seed=8, shake=0.003):
    """(start, landmarks, observations) of cameras along a curve; each point is seen by three neighbours."""
    rng = np.random.default_rng(seed)
    poses = {c: lie.se3_exp(np.array([0.1 * c, 0, 0, 0, 0.002 * c, 0])) for c in range(n)}
    rows, points = [], []
    for i in range(points_n):
        c = int(rng.integers(0, n - 3))
        x = np.linalg.inv(poses[c]) @ np.array([*rng.uniform(-1, 1, 2), rng.uniform(4, 8), 1.0])
        points.append((i, *map(float, x[:3] + 0.02)))
        for p in range(c, c + 3):
            q = poses[p] @ x
            rows.append((i, p, float(500 * q[0] / q[2] + 320), float(500 * q[1] / q[2] + 240), float(q[2])))
    observations = spark.createDataFrame(rows, "landmark_id int, camera_id int, px double, py double, depth double")
    landmarks = spark.createDataFrame([*points, (10**6, 1.0, 2.0, 3.0)], "landmark_id int, x double, y double, z double")
    return {c: lie.se3_exp(rng.normal(size=6) * shake) @ p for c, p in poses.items()}, landmarks, observations


def test_solver_without_camera_blocks(spark):
    """Products by passes over the points give what the dense matrix gives, chunk by chunk."""
    start, landmarks, observations = ring(spark, 8, 120)
    options = {"prior_weight": 1.0, "depth_weight": 1.0, "iterations": 2, "chunk": 50}
    dense = solver.optimize(start, landmarks, observations, scene.K, solver.Options(**options))
    free = solver.optimize(start, landmarks, observations, scene.K, solver.Options(**options, explicit=0, inner=1e-9))
    assert dense.products == 0 < free.products
    assert free.costs == pytest.approx(dense.costs, rel=1e-6) and len(free.costs) > 2
    assert all(np.allclose(free.poses[c], dense.poses[c], atol=1e-7) for c in start)
    near = lambda r: [tuple(x) for x in r.landmarks.orderBy("landmark_id").collect()]
    assert np.allclose(np.array(near(free)), np.array(near(dense)), atol=1e-6)
    # far from solving each step exactly, costs fall nearly as far
    loose = solver.optimize(start, landmarks, observations, scene.K, solver.Options(**options, explicit=0, inner=0.05))
    assert loose.products < free.products / 2 and loose.costs == sorted(loose.costs, reverse=True) and loose.costs[-1] < 0.01 * loose.costs[0]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("observations_")]


def test_solver_on_many_cameras(spark):
    """Costs fall; an unseen landmark is copied through; string ids stay."""
    start, landmarks, observations = ring(spark, 60, 900)
    named = lambda t: t.withColumn("landmark_id", F.concat(F.lit("p"), F.col("landmark_id").cast("string")))
    got = solver.optimize(start, named(landmarks), named(observations), scene.K, solver.Options(prior_weight=0.1, depth_weight=1.0, iterations=8))
    assert got.costs[-1] < 0.02 * got.costs[0] and got.costs == sorted(got.costs, reverse=True)
    assert got.landmarks.count() == 901 and tuple(got.landmarks.where("landmark_id = 'p1000000'").first()) == ("p1000000", 1.0, 2.0, 3.0)
    assert got.stats(spark).count() == len(got.steps) >= len(got.costs) - 1
    with pytest.raises(ValueError):
        solver.optimize(start, landmarks, observations, scene.K, bootstrap=False)


def test_solver_recovers_the_scene(spark):
    errors = scene.solved(spark).collect()
    assert all(r.error < (0.05 if r.kind == "pose" else 0.1) for r in errors)
    start, landmarks, observations = scene.tables(spark)
    got = solver.optimize(start, landmarks, observations, scene.K, solver.Options(iterations=3))
    assert got.costs == sorted(got.costs, reverse=True)
    with pytest.raises(ValueError):
        solver.optimize({}, landmarks, observations, scene.K)


def alternating(spark, n_points=40):
    """(true poses, starting poses, frames, keyframes, cloud, observations) of a wall of small patches."""
    rng = np.random.default_rng(5)
    poses, _ = scene.truth()
    points = np.c_[rng.uniform(-1.2, 1.2, (n_points, 2)), rng.uniform(4, 7, n_points)]
    start = {c: (lie.se3_exp(rng.uniform(-0.004, 0.004, 6)) if c else np.eye(4)) @ p for c, p in poses.items()}
    frames = spark.createDataFrame([(c, 0, as_pose(p)) for c, p in start.items()], f"camera_id int, matched_lidar_id int, initial_pose {POSE}")
    keys = spark.createDataFrame([(0, as_pose(np.eye(4)))], f"lidar_id int, pose {POSE}")
    dense = np.concatenate([x + rng.uniform(-0.03, 0.03, (200, 3)) * [1, 1, 0] for x in points])
    cloud = spark.createDataFrame([(0, *map(float, x)) for x in dense], "lidar_id int, x double, y double, z double")
    rows = []
    for i, x in enumerate(points):
        for c, p in poses.items():
            q = p[:3, :3] @ x + p[:3, 3]
            u, v = 500 * q[0] / q[2] + 320, 500 * q[1] / q[2] + 240
            if 0 <= u < 640 and 0 <= v < 480:
                rows.append((i, c, i, float(u), float(v)))
    obs = spark.createDataFrame(rows, "landmark_id int, camera_id int, kp_idx int, px double, py double")
    return poses, start, frames, keys, cloud, obs


def test_alternation_goes_on_where_it_was_cut(spark, tmp_path):
    """Poses disturbed, depth rendered from clouds: rounds bring the poses nearer to the truth, and a job that is killed
    between or in rounds gives what an unbroken one gives."""
    poses, start, *tables = alternating(spark)
    config = Config(num_iteration=3, landmark_reprojection_error_threshold=12.0, ceres_max_iterations=6)
    options = solver.Options(prior_weight=1.0, iterations=4)
    whole = reconstruct.refine(*tables, scene.K, config, options, half=1)
    after = reconstruct.poses_of(whole.frames, "optimized_pose")
    far = lambda own: sum(np.linalg.norm(lie.se3_log(np.linalg.inv(poses[c] @ np.linalg.inv(poses[0])) @ own[c] @ np.linalg.inv(own[0]))) for c in poses)
    assert far(after) < 0.5 * far(start), (far(after), far(start))
    assert len(whole.costs) == 3 and all(b < a for a, b in zip(whole.starts, whole.costs, strict=True)) and whole.landmarks.count() > 20

    class Killed(Exception):
        pass

    def kill(n, frames):
        if n == 1:
            raise Killed

    state = str(tmp_path / "rounds")
    with pytest.raises(Killed):
        reconstruct.refine(*tables, scene.K, config, options, half=1, state=state, on_round=kill)
    assert sorted(p.name for p in (tmp_path / "rounds").iterdir()) == ["2"]  # superseded rounds are gone
    (tmp_path / "rounds/3/depth").mkdir(parents=True)  # a round that was cut short
    (tmp_path / "rounds/3/depth/part-0.parquet").write_text("half a file")
    seen = []
    again = reconstruct.refine(*tables, scene.K, config, options, half=1, state=state, on_round=lambda n, f: seen.append(n))
    assert seen == [2] and again.costs == pytest.approx(whole.costs, rel=1e-9)
    resumed = reconstruct.poses_of(again.frames, "optimized_pose")
    assert all(np.allclose(resumed[c], after[c], atol=1e-9) for c in after)
    rows = lambda o: sorted((r.landmark_id, r.camera_id, round(r.depth, 6)) for r in o.observations.collect())
    assert rows(again) == rows(whole) and again.landmarks.count() == whole.landmarks.count()
    # a finished state is read, not made again; another problem's is refused
    assert reconstruct.refine(*tables, scene.K, config, options, half=1, state=state, on_round=kill).costs == again.costs
    with pytest.raises(ValueError, match="something else"):
        reconstruct.refine(*tables, scene.K, config, solver.Options(prior_weight=2.0, iterations=4), half=1, state=state)


def test_trajectory(spark):
    rows = [(float(t), float(t), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0) for t in (3, 1, 2)]
    a = spark.createDataFrame(rows, "ts double, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    b = a.withColumn("tx", F.col("tx") + 3).withColumn("ty", F.col("ty") + 4)
    assert trajectory.rmse(a, b).first().rmse == pytest.approx(5.0)
    assert trajectory.rmse(a, b.where("ts > 1")).first().rmse is None
    assert sorted(r.tx for r in trajectory.align_start(a).collect()) == [0.0, 1.0, 2.0]
    assert {(r.hx, r.hy, r.hz) for r in trajectory.with_heading(a).collect()} == {(0.0, 0.0, 1.0)}
    assert trajectory.plot_data(a, 2).where("hx is not null").count() == 2


# --- files ------------------------------------------------------------------------------------------------------------


def test_trajectory_rmse_by_user(spark):
    kind = "user_id int, ts double, tx double, ty double, tz double"
    a = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0), (1, 2.0, 1.0, 0.0, 0.0), (2, 1.0, 5.0, 0.0, 0.0), (3, 1.0, 0.0, 0.0, 0.0)], kind)
    b = spark.createDataFrame([(1, 1.0, 3.0, 4.0, 0.0), (1, 2.0, 1.0, 0.0, 5.0), (2, 1.0, 5.0, 0.0, 2.0)], kind)
    assert {r.user_id: (r.n, r.rmse) for r in trajectory.rmse(a, b, ["user_id"]).collect()} == {1: (2, 5.0), 2: (1, 2.0), 3: (1, None)}
    for r in catalogue.QUERIES["trajectory_rmse"](spark, "/root/testdata/sf0.001").collect():
        assert r.rmse == pytest.approx((sum((0.01 * i) ** 2 + 0.25 for i in range(1, r.n + 1)) / r.n) ** 0.5, abs=1e-6)


def test_config():
    text = "\n".join(f"{k}: {'1' if not k.endswith(('dir', 'dirs', 'path')) else chr(34) + 'a/' + k + chr(34)}  # note" for k in REQUIRED)
    got = Config.parse("# head\n" + text + "\nmax_images: 5\n")
    assert got.max_images == 5 and got.output_path == "a/output_path" and got.ratio_threshold == 1.0 and got.ceres_max_iterations == 50
    with pytest.raises(ValueError, match="min_inliers"):
        Config.parse(text.replace("min_inliers", "other"))


def test_sources(spark, tmp_path):
    from parallaxis.sources import readers, writers

    (tmp_path / "k.txt").write_text("500, 0, 320 9\n0 501 240\n0,0,1\n")
    assert readers.intrinsics(spark, str(tmp_path / "k.txt")) == G.Intrinsics(500.0, 501.0, 320.0, 240.0)
    (tmp_path / "e.json").write_text('{"T_camera_lidar": [[1,0,0,0.5],[0,1,0,0],[0,0,1,0],[0,0,0,1]]}')
    assert readers.extrinsics(spark, str(tmp_path / "e.json"))[0][3] == 0.5
    (tmp_path / "bad.json").write_text('{"T_camera_lidar": [[2,0,0,0],[0,1,0,0],[0,0,1,0],[0,0,0,1]]}')
    with pytest.raises(ValueError, match="orthogonal"):
        readers.extrinsics(spark, str(tmp_path / "bad.json"))
    one = '{"key_frame_id": %d,\n "timestamp": %s, "saved_frame_path": "./c{%d}.ply", "lio_pose": {"translation": [1, 2, 3],\n "quaternion_xyzw": [0, 0, 0, 2]}}'
    (tmp_path / "f.jsonl").write_text(one % (1, 5.5, 1) + "\n" + one % (2, 6.5, 2) + one % (1, 7.5, 3))
    keys = readers.keyframes(spark, str(tmp_path / "f.jsonl"), "data")
    got = {r.lidar_id: r for r in keys.collect()}
    assert got[1].ts == 7.5 and got[1].ply_path == "data/c{3}.ply" and got[2].pose.qw == 1.0
    (tmp_path / "ply").mkdir()
    (tmp_path / "ply/c{2}.ply").write_bytes(b"ply\r\nformat ascii 1.0\r\nelement vertex 2\r\nproperty float x\r\nproperty float i\r\nproperty float y\r\nproperty float z\r\nend_header\r\n1 9 2 3\r\n4 9 5 6\r\n")
    assert [tuple(r) for r in readers.points(spark, keys, str(tmp_path / "ply")).orderBy("x").collect()] == [(2, 1.0, 2.0, 3.0), (2, 4.0, 5.0, 6.0)]
    (tmp_path / "img").mkdir()
    for n in ("b.png", "c.png", "d.png"):
        (tmp_path / "img" / n).write_bytes(b"x")
    (tmp_path / "t.txt").write_text("a.png 1.5\nb.png 2.5 c.png 3.5\nd.png 4.5")
    frames = readers.images(spark, str(tmp_path / "t.txt"), str(tmp_path / "img"), 2)
    assert [(r.camera_id, r.name, r.ts) for r in frames.orderBy("camera_id").collect()] == [(0, "b.png", 2.5), (1, "c.png", 3.5)]
    assert {r.name: r.depth_png is not None for r in readers.depth_images(spark, frames, str(tmp_path / "img")).collect()} == {"b.png": True, "c.png": True}
    posed = frames.withColumn("optimized_pose", G.translation_along(F.col("ts"), 1.0, 2.0))
    writers.write_trajectory(posed, str(tmp_path / "out"))
    assert [(r.ts, r.tx, r.qw) for r in readers.trajectory(spark, str(tmp_path / "out")).collect()] == [(2.5, -2.5, 1.0), (3.5, -3.5, 1.0)]
    writers.write_images(posed, str(tmp_path / "images"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "images")).collect()]
    assert lines[1] == "1 1.0 0.0 0.0 0.0 2.5 1.0 2.0 1 b.png" and lines[2] == "" and lines[3].startswith("2 ")
    for n in ("final", "iter_10", "iter_9", "initial"):
        (tmp_path / "img" / f"{n}.txt").write_text("x")
    names = lambda *a: [p.rsplit("/", 1)[1] for p in readers.trajectory_files(spark, str(tmp_path / "img"), *a)]
    assert names() == ["initial.txt", "final.txt"] and names(True) == ["initial.txt", "iter_9.txt", "iter_10.txt", "final.txt"]


def test_landmark_cache(spark, tmp_path):
    from parallaxis.sources import readers, writers

    data = writers.cache_bytes([(3, 0, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0), (3, 1, 9.0, 9.0, 9.0, 0.0, 0.0, 0.0)], {3: [(0, 5, 1.5, 2.5, 0.0, 0.0, 0)]})
    (tmp_path / "c.bin").write_bytes(data)
    landmarks, observations = readers.landmark_cache(spark, str(tmp_path / "c.bin"))
    assert landmarks.first().initial_position.x == 1.0 and landmarks.count() == 1
    assert observations.first().kp_idx == 5
    (tmp_path / "short.bin").write_bytes(data[:-3])
    with pytest.raises(Exception, match="too early"):
        readers.landmark_cache(spark, str(tmp_path / "short.bin"))
    writers.write_landmarks(landmarks, observations, str(tmp_path / "t"), "abc")
    assert writers.read_landmarks(spark, str(tmp_path / "t"), "other") is None
    assert writers.read_landmarks(spark, str(tmp_path / "none"), "abc") is None
    assert writers.read_landmarks(spark, str(tmp_path / "t"), "abc")[1].count() == observations.count()
