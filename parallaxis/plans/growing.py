"""Connected components of a graph whose edges arrive in batches.

Every node keeps the component it was first found in (its home) in a table that only grows; a second, small table says
where the homes that have met others since then belong. A batch is contracted to the components it touches, so its cost
is a look-up of its nodes and a search among those components; no other node is written again. Batches are numbered and
committed (see `rounds`), and one that is whole already is passed over, so a stream or a restarted job may send it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import Scratch, connected_components
from .rounds import Rounds


class GrowingComponents:
    def __init__(self, spark: SparkSession, folder: str):
        """folder: shared by all executors; an earlier state in it is gone on from."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self.rounds = Rounds(spark, self.folder, "components")

    def _homes(self, record: dict) -> DataFrame:
        return self.spark.read.schema(record["schema"]).parquet(*[f"{self.folder}/homes/{n}" for n in record["parts"]])

    def labels(self) -> DataFrame | None:
        """(node, component) of all batches so far: the least node that each reaches. None before the first batch."""
        last = self.rounds.last()
        if last is None:
            return None
        _, tables, record = last
        moved = tables["moved"].withColumnRenamed("component", "now")
        return self._homes(record).join(moved, "home", "left").select("node", F.coalesce("now", "home").alias("component"))

    def add(self, edges: DataFrame, batch: int, a: str = "a", b: str = "b") -> bool:
        """Takes in a numbered batch of edges; False if that number, or a later one, is in already.

        Null ends and loops make no link, as in `connected_components`; an end whose other end is null is no node. Repeated
        edges don't matter. Nodes are of one orderable type throughout. Fits `foreachBatch` of a stream.
        """
        last = self.rounds.last()
        if last is not None and last[0] >= batch:
            return False
        with Scratch(self.spark) as own:
            new = own.keep(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct())
            kind = dict(new.dtypes)["a"]
            nodes = new.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            if last is None:
                parts, schema = [], f"node {kind}, home {kind}"
                known = nodes.select("node", F.col("node").alias("component"), F.lit(True).alias("fresh"))
            else:
                parts, schema = last[2]["parts"], last[2]["schema"]
                labels = self.labels().join(nodes, "node", "left_semi")
                known = nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("fresh"))
            known = own.keep(known)
            side = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
            met = new.join(side("a"), "a").join(side("b"), "b").select("ca", "cb").where("ca <> cb").distinct()
            found = connected_components(met, "ca", "cb", own).select(F.col("node").alias("was"), F.col("component").alias("now"))
            # a new node's home is where this batch brings it
            homes = known.where("fresh").join(found, F.col("node") == F.col("was"), "left").select("node", F.coalesce("now", "node").alias("home"))
            homes.write.mode("overwrite").parquet(f"{self.folder}/homes/{batch}")
            fresh = known.where("fresh").select(F.col("node").alias("was"))
            moves = found.where("was <> now").join(fresh, "was", "left_anti").select(F.col("was").alias("home"), F.col("now").alias("component"))
            if last is not None:
                before = last[1]["moved"].join(found, F.col("component") == F.col("was"), "left").select("home", F.coalesce("now", "component").alias("component"))
                moves = before.unionByName(moves)
            self.rounds.write(batch, "moved", moves)
        self.rounds.commit(batch, ["moved"], {"parts": [*parts, batch], "schema": schema})
        return True
