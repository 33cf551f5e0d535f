"""Rounds of an iterative plan, each committed as tables and a manifest: a plan that is started again goes on from the
last whole round.

A round's tables are written first, its manifest last, so a round counts when its manifest stands. Tables of a round that
was cut short are overwritten; rounds before the last whole one are deleted. All goes through Spark and its file system,
so a round may lie in any store that executors share.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class Rounds:
    def __init__(self, spark: SparkSession, folder: str, mark: str):
        """mark: what the rounds are of; rounds in the folder that bear another mark are an error."""
        self.spark, self.folder, self.mark = spark, folder.rstrip("/"), mark
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, n: int) -> str:
        return f"{self.folder}/{n}/manifest"

    def _numbers(self) -> list[int]:
        where = self._path(self.folder)
        names = [s.getPath().getName() for s in self._files.listStatus(where)] if self._files.exists(where) else []
        return sorted(int(x) for x in names if x.isdigit())

    def last(self) -> tuple[int, dict[str, DataFrame], dict] | None:
        """(number, tables, record) of the last whole round, or None."""
        for n in reversed(self._numbers()):
            if self._files.exists(self._path(f"{self._manifest(n)}/_SUCCESS")):
                found = json.loads(self.spark.read.text(self._manifest(n)).first().value)
                if found["mark"] != self.mark:
                    raise ValueError(f"{self.folder} holds rounds of something else")
                return n, {name: self.spark.read.parquet(f"{self.folder}/{n}/{name}") for name in found["tables"]}, found["record"]
        return None

    def write(self, n: int, name: str, table: DataFrame) -> DataFrame:
        """A table of a round that isn't whole yet, written and read again."""
        path = f"{self.folder}/{n}/{name}"
        table.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def commit(self, n: int, tables: list[str], record: dict) -> tuple[dict[str, DataFrame], dict]:
        """Makes round n the last whole one; those before it go."""
        line = json.dumps({"mark": self.mark, "tables": tables, "record": record})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(self._manifest(n))
        for old in self._numbers():
            if old < n:
                self._files.delete(self._path(f"{self.folder}/{old}"), True)
        return {name: self.spark.read.parquet(f"{self.folder}/{n}/{name}") for name in tables}, record
