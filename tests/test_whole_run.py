"""Images, features, and the whole run from files to trajectories."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.config import REQUIRED, Config
from parallaxis.functions import lie
from parallaxis.operators import features, matching, solver
from parallaxis.plans import reconstruct
from parallaxis.sources import images, readers


def picture(seed=3, size=(120, 160)):
    """Blobs of many sizes and shapes."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[: size[0], : size[1]]
    out = np.full(size, 90.0)
    for _ in range(60):
        cy, cx, s, a, b = rng.uniform(8, size[0] - 8), rng.uniform(8, size[1] - 8), rng.uniform(2, 7), rng.uniform(0.6, 1.6), rng.uniform(-90, 130)
        out += b * np.exp(-((y - cy) ** 2 * a + (x - cx) ** 2 / a) / (2 * s * s))
    return np.clip(out, 0, 255).astype(np.uint8)


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png(kind, channels):
    rng = np.random.default_rng(channels)
    image = rng.integers(0, np.iinfo(kind).max, (7, 5, channels)).astype(kind)
    data = images.encode_png(image)
    assert np.array_equal(images.decode_png(data), image) and images.size_of(data) == (5, 7)
    # every filter, made here by its definition
    step = channels * np.dtype(kind).itemsize
    raw = image.astype(image.dtype.newbyteorder(">")).reshape(7, -1).view(np.uint8).reshape(7, -1).astype(int)
    lines = []
    for y in range(7):
        f = y % 5
        line = [f]
        for i in range(raw.shape[1]):
            a = raw[y, i - step] if i >= step else 0
            b = raw[y - 1, i] if y else 0
            c = raw[y - 1, i - step] if y and i >= step else 0
            p = a + b - c
            guess = (0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2])[f]
            line.append((raw[y, i] - guess) & 255)
        lines.append(bytes(line))
    at = data.index(b"IDAT") - 4
    body = zlib.compress(b"".join(lines))
    part = len(body).to_bytes(4, "big") + b"IDAT" + body + zlib.crc32(b"IDAT" + body).to_bytes(4, "big")
    assert np.array_equal(images.decode_png(data[:at] + part + data[-12:]), image)
    assert images.gray(image).shape == (7, 5)
    with pytest.raises(ValueError):
        images.decode_png(b"GIF89a")


def test_depth_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    good = rng.integers(0, 3, (4, 6)).astype(np.uint16) * 500
    (tmp_path / "a.png").write_bytes(images.encode_png(good))
    (tmp_path / "b.png").write_bytes(images.encode_png(np.ones((4, 6, 3), np.uint8)))
    (tmp_path / "c.png").write_bytes(images.encode_png(np.ones((5, 6), np.uint8)))
    (tmp_path / "d.png").write_bytes(b"broken")
    frames = spark.createDataFrame([(i, f"{n}.jpg") for i, n in enumerate("abcde")], "camera_id int, name string")
    cells, metrics = images.depth_cells(spark, frames, str(tmp_path), 6, 4, 0.001)
    assert {(r.v, r.u): round(r.depth, 4) for r in cells.collect()} == {(int(v), int(u)): round(good[v, u] * 0.001, 4) for v, u in zip(*np.nonzero(good), strict=True)}
    assert tuple(metrics.first()) == (1, 4)


def test_image_files(spark, tmp_path):
    """JPEG, BMP, palettes, colours, transparency and 16 bits; a file that is no image has nulls."""
    rng = np.random.default_rng(6)
    smooth = np.clip(np.add.outer(np.arange(40) * 3, np.arange(56) * 2), 0, 255).astype(np.uint8)
    colour = np.stack((smooth, 255 - smooth, np.roll(smooth, 9, 1)), axis=2)
    deep = rng.integers(0, 65536, (40, 56)).astype(np.uint16)
    clear = np.concatenate((colour, np.full((40, 56, 1), 255, np.uint8)), axis=2)
    for name, image in (("g", smooth), ("c", colour), ("d", deep), ("t", clear)):
        (tmp_path / f"{name}.png").write_bytes(images.encode_png(image))
    io, file = spark._jvm.javax.imageio.ImageIO, spark._jvm.java.io.File
    for name in "gc":
        read = io.read(file(f"{tmp_path}/{name}.png"))
        assert io.write(read, "jpg", file(f"{tmp_path}/{name}.jpg")) and io.write(read, "bmp", file(f"{tmp_path}/{name}.bmp"))
    few = spark._jvm.java.awt.image.BufferedImage(56, 40, 13)  # with a palette
    few.createGraphics().drawImage(io.read(file(f"{tmp_path}/c.png")), 0, 0, None)
    assert io.write(few, "png", file(f"{tmp_path}/p q+%41.png"))
    (tmp_path / "no.jpg").write_bytes(b"no image")
    names = ["g.png", "g.jpg", "g.bmp", "c.png", "c.jpg", "c.bmp", "t.png", "d.png", "p q+%41.png", "no.jpg"]
    frames = spark.createDataFrame([(i, f"file:{tmp_path}/{n}") for i, n in enumerate(names)], "camera_id long, path string")
    rows = {names[r.camera_id]: r for r in images.gray_images(spark, frames).collect()}
    assert len(rows) == len(names) and rows["no.jpg"].gray is None
    got = {n: np.frombuffer(r.gray, np.uint8).reshape(r.height, r.width).astype(int) for n, r in rows.items() if r.gray is not None}
    assert all(v.shape == (40, 56) for v in got.values())
    want = images.gray(colour).astype(int)
    assert all((got[n] == smooth).all() for n in ("g.png", "g.bmp")) and abs(got["g.jpg"] - smooth).mean() < 3
    assert all((got[n] == want).all() for n in ("c.png", "c.bmp", "t.png")) and abs(got["c.jpg"] - want).mean() < 4
    assert (got["d.png"] == deep >> 8).all() and abs(got["p q+%41.png"] - want).mean() < 20
    assert images.gray_images(spark, frames.where("false")).count() == 0


def test_features_turn_and_shift_with_the_image(spark, tmp_path):
    image = picture()
    at, descriptors = features.detect(image)
    assert len(at) > 20 and descriptors.shape == (len(at), 128) and descriptors.dtype == np.float32
    turned, other = features.detect(np.rot90(image).copy())
    # a pixel (x, y) stands at (y, width - 1 - x) after a quarter turn
    want = np.c_[at[:, 1], image.shape[1] - 1 - at[:, 0]]
    near = np.linalg.norm(want[:, None] - turned[None], axis=2)
    pairs = [(i, int(j)) for i, j in enumerate(near.argmin(1)) if near[i, j] < 0.5]
    assert len(pairs) > 0.8 * len(at)
    far = np.linalg.norm(descriptors[:, None] - other[None], axis=2)
    hits = sum(near[i, int(far[i].argmin())] < 1.0 for i, _ in pairs)
    assert hits > 0.8 * len(pairs)
    assert len(features.detect(image, features=7)[0]) == 7 and len(features.detect(np.full((60, 60), 99, np.uint8))[0]) == 0
    for n, own in ((0, image), (1, np.roll(image, 3, axis=1)), (2, np.full((60, 60), 99, np.uint8))):
        (tmp_path / f"{n}.png").write_bytes(images.encode_png(own))
    frames = spark.createDataFrame([(i, f"file:{tmp_path}/{i}.png") for i in range(3)], "camera_id int, path string")
    found = features.keypoints_of(spark, frames, Config())
    assert found.where("camera_id = 2").count() == 0 and found.where("size(descriptor) != 128").count() == 0
    pairs = spark.createDataFrame([(0, 1)], "camera_1 int, camera_2 int")
    good = matching.match_pixels(matching.ratio_test(matching.knn(found, pairs), 0.8), found.select("camera_id", "kp_idx", "x", "y")).collect()
    assert len(good) > 10 and np.median([abs(r.x2 - r.x1 - 3) + abs(r.y2 - r.y1) for r in good]) < 0.3
    (tmp_path / "3.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="3.png"):
        features.keypoints_of(spark, spark.createDataFrame([(0, f"file:{tmp_path}/3.png")], "camera_id int, path string"), Config()).collect()


def stamp(c):
    return 11.4 + c + 0.15 * (-1) ** c


def make_scene(spark, folder, n=4):
    """Files of a drive past a wall of points: images are stamped up to 0.15 s wrong, so initial poses are off by some cm.

    Returns (settings, keypoints, true poses, world to camera).
    """
    rng = np.random.default_rng(4)
    k, width, height = (300.0, 300.0, 160.0, 120.0), 320, 240
    for name in ("img", "ply"):
        (folder / name).mkdir()
    true_extrinsic = np.eye(4)
    lidar = {i: lie.se3_exp(np.array([0.25 * i, 0.02 * i, 0.05 * (i % 2), 0.0, 0.01 * i, 0.0])) for i in range(n + 2)}
    marks = np.c_[rng.uniform(-1.5, 3.0, 140), rng.uniform(-1.2, 1.2, 140), rng.uniform(4.0, 5.0, 140)]
    dense = np.concatenate([m + np.c_[rng.uniform(-0.04, 0.04, (60, 2)), np.zeros(60)] for m in marks])
    frames, keys = [], []
    for i, pose in lidar.items():
        own = (dense - pose[:3, 3]) @ pose[:3, :3]
        lines = "\n".join(" ".join(f"{v:.6f}" for v in p) for p in own)
        (folder / f"ply/{i}.ply").write_text(f"ply\nformat ascii 1.0\nelement vertex {len(own)}\nproperty float x\nproperty float y\nproperty float z\nend_header\n{lines}\n")
        keys.append({"key_frame_id": i, "timestamp": 10.0 + i, "saved_frame_path": f"./{i}.ply", "lio_pose": {"translation": pose[:3, 3].tolist(), "quaternion_xyzw": lie.quaternion(pose[:3, :3]).tolist()}})
    (folder / "ply/999.ply").write_text("not a point file")  # no keyframe needs it
    (folder / "kf.jsonl").write_text("\n".join(json.dumps(x, indent=1) for x in keys))
    (folder / "e.json").write_text(json.dumps({"T_camera_lidar": true_extrinsic.tolist()}))
    (folder / "k.txt").write_text(f"{k[0]},0,{k[2]}\n0,{k[1]},{k[3]}\n0,0,1\n")
    poses, rows = {}, []
    names = {m: rng.normal(size=128) for m in range(len(marks))}
    for c in range(n):
        poses[c] = true_extrinsic @ np.linalg.inv(lidar[c + 1])
        frames.append(f"{c}.png {stamp(c)}")
        (folder / f"img/{c}.png").write_bytes(images.encode_png(np.zeros((height, width), np.uint8)))
        seen = 0
        for m, x in enumerate(marks):
            p = poses[c][:3, :3] @ x + poses[c][:3, 3]
            u, v = k[0] * p[0] / p[2] + k[2], k[1] * p[1] / p[2] + k[3]
            if 0 <= u < width and 0 <= v < height:
                rows.append((c, seen, float(u), float(v), (names[m] + rng.normal(size=128) * 0.05).tolist()))
                seen += 1
    (folder / "t.txt").write_text("missing.png 1.0\n" + "\n".join(frames))
    keypoints = spark.createDataFrame(rows, "camera_id int, kp_idx int, x float, y float, descriptor array<float>")
    text = {key: "1" for key in REQUIRED} | {
        "input_img_dir": f"{folder}/img", "camera_extrinsic_path": f"{folder}/e.json", "camera_intrinsic_path": f"{folder}/k.txt", "camera_timestamp_path": f"{folder}/t.txt",
        "output_path": f"{folder}/out", "lidar_ply_dirs": f"{folder}/ply", "lidar_kf_path": f"{folder}/kf.jsonl", "ratio_threshold": "0.8", "ransac_threshold": "2.0", "min_inliers": "8",
        "num_iteration": "2", "landmark_reprojection_error_threshold": "8.0", "sequential_match_window_size": "3",
    }
    return Config.parse("\n".join(f"{a}: {b}" for a, b in text.items())), keypoints, poses


def test_whole_run(spark, tmp_path):
    config, keypoints, poses = make_scene(spark, tmp_path)
    loaded = reconstruct.load(spark, config)
    assert [(r.camera_id, r.name, r.matched_lidar_id) for r in loaded.frames.orderBy("camera_id").collect()] == [(i, f"{i}.png", i + 1 - i % 2) for i in range(4)]
    assert (loaded.intrinsics.width, loaded.intrinsics.height) == (320, 240) and loaded.points.select("lidar_id").distinct().count() == 6
    far = lambda own: sum(np.linalg.norm(lie.se3_log(np.linalg.inv(poses[c]) @ own[c])) for c in poses)
    start = reconstruct.poses_of(loaded.frames, "initial_pose")
    options = solver.Options(prior_weight=1.0, iterations=6)
    done = reconstruct.run(spark, config, keypoints, options)
    after = reconstruct.poses_of(done.frames, "optimized_pose")
    assert far(after) < 0.7 * far(start), (far(start), far(after))
    assert len(done.costs) == 2 and all(np.isfinite(done.costs)) and done.landmarks.count() > 40
    out = config.output_path
    assert [p.rsplit("/", 1)[1] for p in (str(x) for x in sorted((tmp_path / "out/trajectory").iterdir()))] == ["final.txt", "initial.txt", "iter_0.txt", "iter_1.txt"]
    last = readers.trajectory(spark, f"{out}/trajectory/final.txt").collect()
    for r, (c, m) in zip(last, sorted(after.items()), strict=True):
        assert r.ts == pytest.approx(stamp(c)) and np.allclose([r.tx, r.ty, r.tz], np.linalg.inv(m)[:3, 3], atol=1e-9)
    lines = [r.value for r in spark.read.text(f"{out}/images.txt").collect()]
    assert lines[0] == "# IMAGE_ID, QW, QX, QY, QZ, TX, TY, TZ, CAMERA_ID, IMAGE_NAME" and len([x for x in lines if x.endswith(".png")]) == 4
    # tracks are those of the marks; stored landmarks are used again, and not for other settings
    matches, observations = reconstruct.landmarks_of(keypoints, config)
    assert matches.where("inlier").count() > 0.9 * matches.count()
    tracks = observations.groupBy("landmark_id").agg(F.count("*").alias("n"), F.countDistinct("camera_id").alias("c")).where("n != c or n < 2")
    assert tracks.count() == 0
    from parallaxis.sources import writers

    assert writers.read_landmarks(spark, f"{out}/landmarks", reconstruct.fingerprint(keypoints, config)) is not None
    assert writers.read_landmarks(spark, f"{out}/landmarks", reconstruct.fingerprint(keypoints.where("kp_idx > 0"), config)) is None
