"""Connected components of an edge table, by alternating large-star and small-star steps.

Every round is a few shuffles on node keys; the edges are written to the shared checkpoint folder after each round, so
lineage stays short and a lost executor costs no more than one round. Nothing is collected but the change counters.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; one of our own only where none is set and all runs on one machine."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def save(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: lineage ends here, and lost executors don't undo it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables written in the shared folder, and deleted as soon as they are no longer needed; as a context, all at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and hasattr(t, "_scratch_path"):
                self._delete(t._scratch_path)

    def clear(self) -> None:
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each action go as it ends; for code whose intermediate results are all saved."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge. Nodes are of one orderable type.

    Null ends and loops make no link; a node that only has a loop is its own component. Repeated edges don't matter.
    Each round's edges are written, by `scratch` if one is given, and the round before them is deleted. A node with very
    many neighbours is met in partial minima and in joins against one row, which AQE splits.
    """
    own = scratch or Scratch(edges.sparkSession)
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = own.keep(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now, before = nodes, None
    while True:
        # large star: the larger neighbours of a node go to its least neighbour (or itself)
        both = now.where("u != v").select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        after = own.keep(small)
        if now is not nodes:
            own.drop(now)
        now = after
        # the edges stay the same when their number and two checksums do
        h = F.xxhash64("u", "v")
        mark = tuple(after.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())
        if mark == before:
            break
        before = mark
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(members, "node", "left_anti").select("node", F.col("node").alias("component"))
    out = own.keep(members.union(alone))
    own.drop(now, nodes)
    return out
