"""Folders that the driver and all executors share, and tables in them that are replaced as a whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one is made on a single machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="shared-")


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


class Versions:
    """A small table kept as numbered Parquet folders: the newest that is whole is the table, so a write is all or nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def numbers(self) -> list[int]:
        fs, path = self._folder()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        whole = [n for n in names if n.isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(map(int, whole))

    def read(self) -> DataFrame:
        have = self.numbers()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{have[-1]}") if have else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> None:
        """The next version; the one before it stays, as rows may be read from it, older ones go."""
        have = self.numbers()
        at = have[-1] + 1 if have else 0
        columns = self.spark.createDataFrame([], self.schema).columns
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{at}")
        fs, _ = self._folder()
        for old in have[:-1]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}"), True)
