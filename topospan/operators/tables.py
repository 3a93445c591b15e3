"""Cutting lineage: tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; a temporary folder only where it isn't, on a local master, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            folder = own.get()
        elif spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            folder = "file://" + tempfile.mkdtemp(prefix="topospan-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Table:
    """A written Parquet table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.df = spark.read.parquet(path)

    def _at(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def size(self) -> int:
        fs, p = self._at()
        return fs.getContentSummary(p).getLength()

    def drop(self) -> None:
        fs, p = self._at()
        fs.delete(p, True)


def written(df: DataFrame, what: str) -> Table:
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Table(df.sparkSession, path)


def broadcast_if_small(df: DataFrame, what: str, most: int = SMALL_BYTES) -> DataFrame:
    """`df`, written, and marked for a broadcast only if its files have at most `most` bytes."""
    table = written(df, what)
    return F.broadcast(table.df) if table.size() <= most else table.df
