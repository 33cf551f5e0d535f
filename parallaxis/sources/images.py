"""Images: sizes from headers, gray values of files that Spark decodes, 16-bit PNG in numpy, and depth images as rows."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .readers import depth_images, literal


def size_of(data: bytes) -> tuple[int, int]:
    """(width, height) by the header of a PNG, BMP or JPEG file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                break
            kind, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + n
    raise ValueError("the size of the image can't be read")


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of a PNG file of 8 or 16 bits without a palette or interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if head is None:
        raise ValueError("a PNG file without a header")
    width, height, bits, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if channels is None or bits not in (8, 16) or interlaced:
        raise ValueError("a kind of PNG that isn't read")
    step = channels * bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    out, above = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 0:
            own = line.copy()
        elif kind == 1:
            own = np.cumsum(line.reshape(width, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            own = line + above
        else:
            own = np.zeros_like(line)
            wide, up, old = line.astype(int), above.astype(int), np.zeros(step, int)
            corner = np.zeros(step, int)
            for x in range(0, len(line), step):
                b = up[x : x + step]
                if kind == 3:
                    guess = (old + b) // 2
                else:
                    p = old + b - corner
                    pa, pb, pc = abs(p - old), abs(p - b), abs(p - corner)
                    guess = np.where((pa <= pb) & (pa <= pc), old, np.where(pb <= pc, b, corner))
                corner = b
                old = (wide[x : x + step] + guess) & 255
                own[x : x + step] = old
        out[y] = above = own
    if bits == 16:
        return out.reshape(height, width, channels, 2).view(">u2")[..., 0].astype(np.uint16)
    return out.reshape(height, width, channels)


def encode_png(image: np.ndarray) -> bytes:
    """A PNG file of an (height, width[, channels]) array of 8 or 16 bits."""
    image = image[..., None] if image.ndim == 2 else image
    height, width, channels = image.shape
    bits = 16 if image.dtype == np.uint16 else 8
    rows = image.astype(">u2" if bits == 16 else np.uint8).reshape(height, -1).view(np.uint8).reshape(height, -1)
    body = zlib.compress(np.concatenate((np.zeros((height, 1), np.uint8), rows), axis=1).tobytes())

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, bits, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", body) + part(b"IEND", b"")


def gray(image: np.ndarray) -> np.ndarray:
    """8-bit gray values of an image; colours weigh 0.299, 0.587 and 0.114."""
    if image.dtype == np.uint16:
        image = (image >> 8).astype(np.uint8)
    if image.shape[2] < 3:
        return image[..., 0]
    return np.rint(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _same(path):
    """Paths as both readers write them: `file:/x` for `file:///x`."""
    return F.regexp_replace(path, "^([A-Za-z0-9.+-]+):/+", "$1:/")


def gray_images(spark: SparkSession, frames: DataFrame) -> DataFrame:
    """(camera_id, path, height, width, gray): 8-bit gray values of the frames' images (camera_id, path), dealt by camera.

    Files are decoded by Spark's image source, in the JVM: JPEG, PNG (with palettes, interlaced), BMP and what else its
    runtime reads; of 16-bit PNG files, which it would cut to their lower bytes, the upper bytes are taken here. A file
    that can't be decoded has nulls.
    """
    kind = dict(frames.dtypes)["camera_id"]
    paths = [literal(r.path) for r in frames.select("path").collect()]
    shape = f"camera_id {kind}, path string, height int, width int, gray binary"
    if not paths:
        return spark.createDataFrame([], shape)
    own = frames.select("camera_id", "path", _same(F.col("path")).alias("__at"))
    files = spark.read.format("binaryFile").load(paths)
    deep = (F.substring("content", 1, 4) == F.lit(b"\x89PNG")) & (F.substring("content", 25, 1) == F.lit(b"\x10"))
    wide = files.where(deep).select(_same(F.col("path")).alias("__at"), F.col("content").alias("png"))
    origin = F.try_url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))  # written as a URI
    decoded = spark.read.format("image").option("dropInvalid", False).load(paths).select(_same(origin).alias("__at"), "image.height", "image.width", "image.nChannels", "image.data")
    met = own.join(decoded, "__at", "left").join(wide, "__at", "left").drop("__at").repartition("camera_id")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                image = None
                if row["png"] is not None:
                    try:
                        image = gray(decode_png(row["png"]))
                    except (ValueError, zlib.error):
                        pass
                elif row["nChannels"] is not None and row["nChannels"] > 0:
                    image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
                    image = gray(image[..., 2::-1] if row["nChannels"] >= 3 else image)  # stored blue first
                height, width = (None, None) if image is None else image.shape
                values = [row["camera_id"], row["path"], height, width, None if image is None else np.ascontiguousarray(image).tobytes()]
                yield pa.record_batch([pa.array([v], f.type) for v, f in zip(values, types, strict=True)], schema=types)

    types = to_arrow_schema(spark.createDataFrame([], shape).schema)
    return met.select("camera_id", "path", "height", "width", "nChannels", "data", "png").mapInArrow(run, shape)


def first_size(spark: SparkSession, frames: DataFrame) -> tuple[int, int]:
    """(width, height) of the first frame's image: all are taken to have it."""
    first = frames.orderBy("camera_id").select("path").first()
    if first is None:
        raise ValueError("no images")
    return size_of(bytes(spark.read.format("binaryFile").load(literal(first.path)).select(F.substring("content", 1, 1 << 20).alias("head")).first()["head"]))


def depth_cells(spark: SparkSession, frames: DataFrame, directory: str, width: int, height: int, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(cells, metrics): (camera_id, v, u, depth) of the depth images of one channel and the right size; others, and frames
    without one, are counted as missing. Empty pixels (0) make no row."""
    found = depth_images(spark, frames, directory).select("camera_id", "depth_png")

    def read(parts):
        for pdf in parts:
            for camera, data in zip(pdf["camera_id"], pdf["depth_png"], strict=True):
                image = None
                if data is not None:
                    try:
                        image = decode_png(bytes(data))
                    except (ValueError, zlib.error):
                        pass  # counted as missing below
                if image is None or image.shape != (height, width, 1):
                    yield pd.DataFrame({"camera_id": [camera], "v": [None], "u": [None], "depth": [None]})
                    continue
                v, u = np.nonzero(image[..., 0])
                yield pd.DataFrame({"camera_id": camera, "v": [None, *v.tolist()], "u": [None, *u.tolist()], "depth": [0.0, *(image[v, u, 0] * scale).tolist()]})

    rows = found.mapInPandas(read, f"camera_id {dict(frames.dtypes)['camera_id']}, v int, u int, depth float")
    heads = rows.where("v is null")
    metrics = heads.agg(F.count("depth").alias("loaded"), F.count(F.when(F.col("depth").isNull(), 1)).alias("missing"))
    return rows.where("v is not null"), metrics
