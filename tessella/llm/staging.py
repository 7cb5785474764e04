"""Shared folder, staged tables and small conveniences of the llm operators.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``; only where that is unset (tests, laptops) a fresh
temporary folder is used and set for the session.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
BATCH_BYTES = 4 << 20
BROADCAST_BYTES = 32 << 20  # in memory


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most BATCH_BYTES: rows vary from a few bytes to whole books."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Staged:
    """A table written once and read from the shared folder afterwards."""

    def __init__(self, df: DataFrame, name: str, codec: str = "zstd"):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = new_path(self.spark, name)
        df.write.option("compression", codec).parquet(self.path)

    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def bytes(self) -> int:
        """Size of the files, asked of the file system (no job)."""
        path, fs = _fs(self.spark, self.path)
        return fs.getContentSummary(path).getLength()

    def rows(self) -> int:
        """From the files' footers."""
        return self.df().count()

    def drop(self) -> None:
        path, fs = _fs(self.spark, self.path)
        fs.delete(path, True)


def small(t: Staged, width: int = 0) -> DataFrame:
    """For a join: broadcast behind a check of rows times bytes a row (of longs, if not said), shuffled beyond."""
    files = t.bytes()  # a table's rows are counted only where its files do not settle it
    fits = files * 64 <= BROADCAST_BYTES or files <= BROADCAST_BYTES and t.rows() * (width or 16 + 8 * len(t.schema)) <= BROADCAST_BYTES
    return F.broadcast(t.df()) if fits else t.df()


class Bucketed:
    """A table written once, dealt out and sorted by a column, so that joins on it need no exchange."""

    def __init__(self, df: DataFrame, name: str, by: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        self.name = "tessella_" + self.path.rsplit("/", 1)[1].replace("-", "_")
        df.write.bucketBy(partitions(self.spark), by).sortBy(by).option("path", self.path).option("compression", "zstd").saveAsTable(self.name)

    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        path, fs = _fs(self.spark, self.path)
        fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more; without it they wait for a collection of the driver's memory."""
    gc.collect()
    spark._jvm.System.gc()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
