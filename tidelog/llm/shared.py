"""Tables between the steps of an operator, kept where every executor can read them."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Most bytes of a batch that goes to or comes from Python; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one is made on a single machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def in_arrow(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow in batches of bounded bytes: rows may be long, and Spark bounds only their number unless told so."""
    conf = rows.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def saved(rows: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written once and their lineage is cut."""
    folder(rows.sparkSession)
    return rows.checkpoint(eager=True)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that no table reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
