"""What the operators share: the shared folder, cut lineage, folds and Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's spark.checkpoint.dir (or the context's checkpoint folder) is used where it is
    set. Where neither is set, a temporary folder is made on a local master, as in tests; on a
    cluster that raises, since executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            folder = own.get()
        elif not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            folder = "file://" + tempfile.mkdtemp(prefix="topospan-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Table:
    """A written Parquet table; `drop()` deletes its files once nothing reads them any more."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.df = spark.read.parquet(path)

    def size(self) -> int:
        """Bytes of its files."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

    def drop(self) -> None:
        _LEFT.pop(self.path, None)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, what: str) -> Table:
    """`df` as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = Table(spark, path)
    _LEFT[path] = table
    return table


#: Tables that nobody has dropped: results read them lazily, so they go when the driver ends.
_LEFT: dict[str, Table] = {}


@atexit.register
def _drop_all() -> None:
    for table in list(_LEFT.values()):
        with contextlib.suppress(Exception):  # the session may have stopped already
            table.drop()


def as_row(df: DataFrame) -> Column:
    """All columns of `df` as one struct, so that they can't clash with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]

