"""Tables in the folder that the driver and all executors share.

Lineage is cut by writing a table here and reading it back, so a lost executor costs a retry of the
tasks that it ran and never the whole job.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from typing import ClassVar

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode and an error on a cluster."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        path = tempfile.mkdtemp(prefix="gristmill-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _LOCAL[sc.applicationId] = path
    return "file://" + _LOCAL[sc.applicationId]


class Workspace:
    """One run's folder below the shared root; what still stands there goes when the application ends."""

    #: Those that nobody has dropped yet, oldest first.
    open: ClassVar[list[Workspace]] = []

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        at, store = self._store()
        store.mkdirs(at)
        store.deleteOnExit(at)
        Workspace.open.append(self)

    def _store(self, name: str = ""):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete a table that nothing reads any more, or the whole folder."""
        at, store = self._store(name)
        store.delete(at, True)
        if not name and self in Workspace.open:
            Workspace.open.remove(self)

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Write a result and drop all else that stands here."""
        df = self.write(df, name)
        at, store = self._store()
        for status in store.listStatus(at):
            if status.getPath().getName() != name:
                store.delete(status.getPath(), True)
        return df


def few(table: DataFrame, rows: int, most: int = 10_000) -> DataFrame:
    """Broadcast a table whose rows have been counted, if there are `most` at most; else leave the join to Spark."""
    return F.broadcast(table) if rows <= most else table


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path behind a URI of the shared folder."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with columns named by their place, so that no name clashes with an operator's own."""
    return docs.toDF(*(f"__c{k}" for k in range(len(docs.columns))))


def place(docs: DataFrame, name: str) -> str:
    """What numbered() calls a column."""
    return f"__c{docs.columns.index(name)}"


def named(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, by their own names, from a frame that came of numbered(docs)."""
    return df.select(*(F.col(f"__c{k}").alias(c) for k, c in enumerate(docs.columns)))
