"""Scans of the reconstruction's input files, through Spark's readers only."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..operators.components import save
from ..operators.ranking import row_numbers


def _text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"no file, or more than one: {path}")
    return rows[0].value


def intrinsics(spark: SparkSession, path: str, width: int = 0, height: int = 0) -> G.Intrinsics:
    """Three lines of three numbers, apart by commas or spaces; more tokens are ignored."""
    rows = [[float(x) for x in line.replace(",", " ").split()[:3]] for line in _text(spark, path).splitlines()[:3]]
    if len(rows) < 3 or any(len(r) < 3 for r in rows):
        raise ValueError("intrinsics need three lines of three numbers")
    return G.Intrinsics(rows[0][0], rows[1][1], rows[0][2], rows[1][2], width, height)


def matrix4(value: object) -> list[list[float]]:
    """A 4 x 4 list of numbers, or an error."""
    if not isinstance(value, list) or len(value) != 4 or any(not isinstance(r, list) or len(r) != 4 for r in value):
        raise ValueError("a 4 x 4 matrix expected")
    return [[float(x) for x in r] for r in value]


def extrinsics(spark: SparkSession, path: str) -> list[list[float]]:
    """T_camera_lidar of a JSON file; its rotation must be orthogonal."""
    import numpy as np

    from ..functions.lie import is_orthogonal

    found = json.loads(_text(spark, path))
    if "T_camera_lidar" not in found:
        raise ValueError("T_camera_lidar is missing")
    m = matrix4(found["T_camera_lidar"])
    if not is_orthogonal(np.array(m)[:3, :3]):
        raise ValueError("the rotation of T_camera_lidar is not orthogonal")
    return m


def pose_column(matrix: list[list[float]]):
    """A 4 x 4 matrix as a pose Column."""
    import numpy as np

    from ..functions.lie import quaternion

    m = np.array(matrix)
    return G.pose(*(float(x) for x in (*quaternion(m[:3, :3]), *m[:3, 3])))


def json_objects(text: str) -> Iterator[dict]:
    """The JSON objects of a text, which may follow each other on any number of lines."""
    decoder, at = json.JSONDecoder(), 0
    while (at := text.find("{", at)) >= 0:
        value, at = decoder.raw_decode(text, at)
        yield value


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(place, value): the text of each JSON object of a file, or of a few on one line, numbered from 0 in their order.

    Lines are read split by split. Strings hold no line breaks, so what a line adds to the depth of braces outside
    strings is known by itself; running sums within a split, and over the splits' totals, give the depth after each line.
    Lines from one depth of zero to the next meet as one record, also across splits. A closing brace too many is passed
    over, and an object that never closes is the last record. A line is the least that a task reads.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"))
    bare = F.regexp_replace("value", r'"(?:[^"\\]|\\.)*+"', "")
    count = lambda brace: F.length(bare) - F.length(F.replace(bare, F.lit(brace), F.lit("")))
    split = ["file", "start"]
    inside = Window.partitionBy(*split).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # over splits, one row each
    run = lines.withColumn("step", count("{") - count("}")).withColumn("sum", F.sum("step").over(inside)).withColumn("low", F.min("sum").over(inside))
    totals = run.groupBy(*split).agg(F.sum("step").alias("all"), F.min("sum").alias("least"))
    ahead = totals.withColumn("ahead", F.coalesce(F.sum("all").over(before), F.lit(0)))
    ahead = ahead.select(*split, "ahead", F.least(F.lit(0), F.min(F.col("ahead") + F.col("least")).over(before)).alias("floor"))
    depth = F.col("ahead") + F.col("sum") - F.least("floor", F.col("ahead") + F.col("low"))
    closed = run.join(ahead, split).withColumn("closes", (depth == 0).cast("int")).withColumn("here", F.sum("closes").over(inside) - F.col("closes"))
    ends = closed.groupBy(*split).agg(F.sum("closes").alias("ends")).withColumn("passed", F.coalesce(F.sum("ends").over(before), F.lit(0))).drop("ends")
    numbered = closed.join(ends, split).withColumn("place", F.col("passed") + F.col("here"))
    whole = numbered.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("file", "start", "i", "value"))).alias("rows"))
    return whole.select("place", F.array_join(F.col("rows.value"), "\n").alias("value")).where(F.contains("value", F.lit("{")))


def keyframes(spark: SparkSession, path: str, ply_dir: str = "") -> DataFrame:
    """(lidar_id, ts, ply_path, pose): of several objects with one id the last counts; quaternions are normalised.

    Objects are parsed by the tasks that hold them; see `json_records`.

    The first character of a saved path is dropped, and the directory stands before the rest.
    """
    schema = "place array<long>, lidar_id int, ts double, ply_path string, q array<double>, t array<double>"

    def split(parts):
        for pdf in parts:
            for place, text in zip(pdf["place"], pdf["value"], strict=True):
                rows = [
                    ([place, i], int(o["key_frame_id"]), float(o["timestamp"]), ply_dir + o["saved_frame_path"][1:], [float(x) for x in o["lio_pose"]["quaternion_xyzw"]], [float(x) for x in o["lio_pose"]["translation"]])
                    for i, o in enumerate(json_objects(text))
                ]
                yield pd.DataFrame(rows, columns=["place", "lidar_id", "ts", "ply_path", "q", "t"])

    rows = json_records(spark, path).mapInPandas(split, schema)
    last = rows.withColumn("n", F.row_number().over(Window.partitionBy("lidar_id").orderBy(F.desc("place")))).where("n = 1")
    pose = G.pose(*(F.col("q")[i] for i in range(4)), *(F.col("t")[i] for i in range(3)))
    return last.select("lidar_id", "ts", "ply_path", pose.alias("pose"))


def images(spark: SparkSession, list_path: str, image_dir: str, max_images: int = -1) -> DataFrame:
    """(camera_id, name, path, ts) of listed images that exist, in the list's order; others take no id."""
    words = spark.read.text(list_path, wholetext=True).select(F.filter(F.split("value", r"\s+"), lambda w: w != "").alias("w"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 2).cast("int") - 1), lambda i: F.struct(i.alias("place"), F.get("w", 2 * i).alias("name"), F.get("w", 2 * i + 1).cast("double").alias("ts")))
    listed = words.where("size(w) >= 2").select(F.inline(pairs))
    there = spark.read.format("binaryFile").load(image_dir).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path")
    kept = row_numbers(listed.join(there, "name"), ["place"], "__row").withColumn("camera_id", (F.col("__row") - 1).cast("int"))
    kept = kept if max_images < 0 else kept.where(F.col("camera_id") < max_images)
    return kept.select("camera_id", "name", "path", "ts")


def literal(path: str) -> str:
    """A path whose special characters stand for themselves."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def parse_ply(data: bytes) -> list[tuple[float, float, float]]:
    """x, y, z of the vertices of an ASCII file, by the properties that its header declares."""
    head, _, body = re.sub(rb"\r\n?", b"\n", data).partition(b"end_header\n")
    count, names, inside = 0, [], False
    for line in head.decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"] and words[1] != "ascii":
            raise ValueError("only ASCII point files are read")
        if words[:1] == ["element"]:
            inside = words[1] == "vertex"
            count = int(words[2]) if inside else count
        elif words[:1] == ["property"] and inside:
            names.append(words[-1])
    names = names or ["x", "y", "z"]
    at = [names.index(c) for c in "xyz"]
    tokens = body.split()
    if len(tokens) < count * len(names):
        raise ValueError("the point file ends too early")
    return [tuple(float(tokens[i * len(names) + a]) for a in at) for i in range(count)]


def points(spark: SparkSession, keyframe_table: DataFrame, ply_glob: str, required: DataFrame | None = None) -> DataFrame:
    """(lidar_id, x, y, z) of the clouds of keyframes (with an id of `required`, if given); write it once as Parquet,
    partitioned by lidar_id. Files of other keyframes aren't opened: names are joined before contents are read."""

    def read(parts):
        for pdf in parts:
            for lidar_id, content in zip(pdf["lidar_id"], pdf["content"], strict=True):
                xyz = parse_ply(content)
                yield pd.DataFrame(xyz, columns=["x", "y", "z"]).assign(lidar_id=lidar_id)[["lidar_id", "x", "y", "z"]]

    schema = "lidar_id int, x double, y double, z double"
    named = keyframe_table.select("lidar_id", F.element_at(F.split("ply_path", "/"), -1).alias("file"))
    if required is not None:
        named = named.join(required.select("lidar_id").distinct(), "lidar_id", "left_semi")
    listed = spark.read.format("binaryFile").load(ply_glob).select("path", F.element_at(F.split("path", "/"), -1).alias("file"))
    wanted = [r.path for r in listed.join(named.select("file").distinct(), "file", "left_semi").select("path").collect()]  # one name for each cloud
    if not wanted:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load([literal(w) for w in wanted]).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(F.broadcast(named), "file").select("lidar_id", "content").mapInPandas(read, schema)


def depth_images(spark: SparkSession, frames: DataFrame, directory: str) -> DataFrame:
    """Frames with the content of `<directory>/<image stem>.png`, null where there is none."""
    stem = lambda c: F.regexp_extract(F.col(c), r"([^/]+?)(?:\.[^./]*)?$", 1)
    files = spark.read.format("binaryFile").load(directory).where("path like '%.png'").select(stem("path").alias("__stem"), F.col("content").alias("depth_png"))
    return frames.withColumn("__stem", stem("name")).join(files, "__stem", "left").drop("__stem")


def parse_cache(data: bytes) -> Iterator[tuple[tuple, list[tuple]]]:
    """Each landmark (id, optimized, six coordinates) of a binary cache with its observations."""
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        size = struct.calcsize(form)
        if at + size > len(data):
            raise ValueError("the landmark cache ends too early")
        at += size
        return struct.unpack_from(form, data, at - size)

    for _ in range(take("<q")[0]):
        head = (*take("<ib"), *take("<6d"))
        yield head, [take("<iiddddb") for _ in range(take("<q")[0])]


def landmark_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(landmarks, observations) of a binary cache file; one that ends too early is an error, and of several landmarks
    with one id the first counts. A task parses the file; the tables are read from what it wrote."""
    vec = "struct<x:double,y:double,z:double>"
    landmark = f"landmark_id int, optimized boolean, initial_position {vec}, optimized_position {vec}"
    observation = "array<struct<camera_id:int,kp_idx:int,px:double,py:double,depth:double,optimized_depth:double,optimized:boolean>>"
    names = ("camera_id", "kp_idx", "px", "py", "depth", "optimized_depth", "optimized")

    def parse(parts):
        for pdf in parts:
            for content in pdf["content"]:
                seen, rows = set(), []
                for (ident, done, *x), own in parse_cache(bytes(content)):
                    if ident not in seen:
                        seen.add(ident)
                        rows.append((ident, bool(done), dict(zip("xyz", x[:3], strict=True)), dict(zip("xyz", x[3:], strict=True)), [dict(zip(names, (*o[:-1], bool(o[-1])), strict=True)) for o in own]))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["landmark_id", "optimized", "initial_position", "optimized_position", "obs"])
                        rows = []
                yield pd.DataFrame(rows, columns=["landmark_id", "optimized", "initial_position", "optimized_position", "obs"])

    rows = save(spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, f"{landmark}, obs {observation}"))
    return rows.drop("obs"), rows.select("landmark_id", F.inline("obs"))


TRAJECTORY = "ts double, tx double, ty double, tz double, qx double, qy double, qz double, qw double"


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Poses of a text file in the order of time; an empty file is an error."""
    words = F.split(F.trim("value"), r"\s+")
    names = [x.split()[0] for x in TRAJECTORY.split(", ")]
    rows = spark.read.text(path).where("trim(value) != ''").select(*[words[i].cast("double").alias(n) for i, n in enumerate(names)])
    if not rows.limit(1).count():
        raise ValueError(f"no poses in {path}")
    return rows.orderBy("ts")


def trajectory_files(spark: SparkSession, directory: str, all_rounds: bool = False) -> list[str]:
    """initial.txt, then iter_<n>.txt in the order of n if asked for, then final.txt; those that exist."""
    paths = [r.path for r in spark.read.format("binaryFile").load(directory).where("path like '%.txt'").select("path").collect()]
    by_name = {p.rsplit("/", 1)[-1]: p for p in paths}
    rounds = sorted((int(m[1]), n) for n in by_name if (m := re.fullmatch(r"iter_(\d+)\.txt", n)))
    names = ["initial.txt", *([n for _, n in rounds] if all_rounds else []), "final.txt"]
    return [by_name[n] for n in names if n in by_name]
