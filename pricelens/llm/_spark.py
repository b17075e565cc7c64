"""Small Spark helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, for btrim() and for split().
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
#: Binary logarithm of the bits of an id filter, at most: 8 MB.
FILTER_BITS = 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own, on one machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="pricelens-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, path: str) -> DataFrame:
    """df, computed once, as a table at path: unlike cut(), later reads take the columns that they need only."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, as a table in the shared folder."""
    return written(df, shared_folder(df.sparkSession, name))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of ours that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bits_of(cells: DataFrame, size: int) -> np.ndarray:
    """size bits, 64 to a number, of which those in cells (their only column) are set. They are gathered by Spark."""
    c = cells.columns[0]
    packed = cells.groupBy(F.shiftright(c, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({c} & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(max(1, size >> 6), np.uint64)
    out[packed["at"].to_numpy()] = packed["bits"].to_numpy().view(np.uint64)
    return out


class IdFilter:
    """Tells every id in ids (their only column), and few others, by a bit array of at most 2**bits bits.

    It is made by Spark and broadcast, so that rows without one of the ids need not move. Of more ids
    than bits it lets more rows through, and loses none.
    """

    def __init__(self, ids: DataFrame, bits: int = FILTER_BITS) -> None:
        self.bits = min(bits, max(16, (16 * ids.count()).bit_length()))
        self.shared = ids.sparkSession.sparkContext.broadcast(bits_of(ids.select(self.place(F.col(ids.columns[0])).alias("cell")), 1 << self.bits))

    def place(self, c: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(c), 64 - self.bits)

    def where(self, c: Column) -> Column:
        """Whether an id is told."""
        shared = self.shared

        @F.pandas_udf("boolean")
        def hit(p: pd.Series) -> pd.Series:
            return pd.Series(marked(shared.value, p.to_numpy()))

        return hit(self.place(c))


def marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at these places are set."""
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)) > 0


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, but not known to be partitioned by keys (long): a join with sums by a key then shuffles both sides on its own, and Spark can split a hot key."""
    return df.withColumns({k: F.col(k).bitwiseOR(F.lit(0).cast("long")) for k in keys})


def quoted(name: str) -> str:
    """The name of a column, dots and all, as F.col() takes it."""
    return "`" + name.replace("`", "``") + "`"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN, -1))
