"""Tables that are computed once and kept in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a folder of our own, for a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="pricelens-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, *by: str) -> DataFrame:
    """df as a Parquet table at path, read again; by: columns whose values are folders."""
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df, computed once, as a table in the shared folder."""
    return written(df, shared_folder(df.sparkSession, name), *by)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def length(spark: SparkSession, path: str) -> int:
    """Bytes of the files under path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def identity(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, lengths and times of all files under paths: it changes when the data do."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    told = []
    for path in paths:
        at = hadoop(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            told.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(told)).encode()).hexdigest()[:24]


def kept(spark: SparkSession, name: str, inputs: list[str], build: Callable[[str], object]) -> str:
    """The path at which build(path) has written what it derives from inputs, once for each state of them in the shared folder.

    It is built beside and then moved there as a whole, so that a build that is lost half-way leaves
    nothing that could be taken for one, and of two at once the first stays.
    """
    path = f"{shared_dir(spark).rstrip('/')}/kept-{name}-{identity(spark, inputs)}"
    if not exists(spark, path):
        own = shared_folder(spark, f"building-{name}")
        build(own)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(own).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if exists(spark, path) or not fs.rename(hadoop(own), hadoop(path)):
            if not exists(spark, path):
                raise OSError(f"{own} could not be moved to {path}")
            remove(spark, own)
    return path
