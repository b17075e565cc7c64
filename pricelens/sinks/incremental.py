"""Tables that streams change batch by batch, so that a batch that comes twice changes nothing.

A table's rows lie in parts by a hash of the key. A batch writes new versions of the parts that it
touches and then a manifest, the versions of all parts: only that makes the batch count. A batch
whose manifest is there is passed over; one that was lost before is done again from the same versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from . import upsert


def commit(spark: SparkSession, df: DataFrame, path: str) -> None:
    """df at path as a whole or not at all."""
    own = f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.parquet(own)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(own).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(hadoop(own), hadoop(path)):
        raise OSError(f"{path} is there already")


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that have a manifest at path."""
    if not storage.exists(spark, path):
        return []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = hadoop(path)
    names = (f.getPath().getName() for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at))
    return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-") and "." not in n)


@dataclass
class UpsertTable:
    """A table with one row a key, at path."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    parts: int = 64

    def manifest(self) -> dict[int, int]:
        """The version of each part: one row for each of parts."""
        done = batches(self.spark, f"{self.path}/manifest")
        return {r.part: r.version for r in self.spark.read.parquet(f"{self.path}/manifest/batch-{done[-1]}").collect()} if done else {}

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """The table's rows, of some parts if asked for."""
        held = [f"{self.path}/rows/version={v}/part={p}" for p, v in sorted(self.manifest().items()) if only is None or p in only]
        return self.spark.read.schema(self.schema).parquet(*held) if held else self.spark.createDataFrame([], self.schema)

    def apply(self, incoming: DataFrame, batch: int, order: str, mutable: Sequence[str]) -> bool:
        """The incoming rows upserted as batch; whether they were new. Batches come in the order of their numbers."""
        done = batches(self.spark, f"{self.path}/manifest")
        if done and batch <= done[-1]:
            return False
        part = F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")
        now = storage.written(incoming, f"{self.path}/incoming/{uuid.uuid4().hex}")
        touched = [r[0] for r in now.where(F.col(self.key).isNotNull()).select(part).distinct().collect()]
        held = self.manifest()
        rows = upsert(self.read(touched), now, self.key, order, mutable)
        # A version of a batch that was lost half-way is overwritten.
        rows.withColumn("part", part).repartition("part").write.partitionBy("part").mode("overwrite").parquet(f"{self.path}/rows/version={batch}")
        held |= {p: batch for p in touched}
        commit(self.spark, self.spark.createDataFrame(sorted(held.items()), "part int, version long"), f"{self.path}/manifest/batch-{batch}")
        return True


@dataclass
class Journal:
    """What each of several sinks has taken, at path: a batch and sink at most once, and failures by name."""

    spark: SparkSession
    path: str

    def done(self, sink: str) -> list[int]:
        return batches(self.spark, f"{self.path}/{sink}/done")

    def once(self, sink: str, batch: int, write: Callable[[str], object]) -> bool:
        """Runs write(path) for a batch that the sink has not taken; whether it did. The path is the batch's own, so what a lost try has left is overwritten."""
        if batch in self.done(sink):
            return False
        write(f"{self.path}/{sink}/rows/batch={batch}")
        commit(self.spark, self.spark.createDataFrame([(batch,)], "batch long"), f"{self.path}/{sink}/done/batch-{batch}")
        return True

    def rows(self, sink: str, schema: str) -> DataFrame:
        """What the sink holds of the batches that it has taken."""
        held = [f"{self.path}/{sink}/rows/batch={b}" for b in self.done(sink)]
        return self.spark.read.schema(schema).parquet(*held) if held else self.spark.createDataFrame([], schema)


def overwrite(df: DataFrame) -> Callable[[str], None]:
    return lambda path: df.write.mode("overwrite").parquet(path)


@dataclass
class EventSinks:
    """foreachBatch target: events go to their sink, then what alerts(events) makes of them to the sink of alerts.

    A failure of the latter is written down and loses neither the events nor the stream; retry() makes
    up for the batches that lack their alerts, from the events as they were stored.
    """

    journal: Journal
    schema: str
    alerts: Callable[[DataFrame], DataFrame]

    def __call__(self, events: DataFrame, batch: int) -> None:
        self.journal.once("events", batch, overwrite(events))
        self.alert(batch)

    def stored(self, batch: int) -> DataFrame:
        return self.journal.spark.read.schema(self.schema).parquet(f"{self.journal.path}/events/rows/batch={batch}")

    def alert(self, batch: int) -> bool:
        try:
            self.journal.once("alerts", batch, lambda path: overwrite(self.alerts(self.stored(batch)))(path))
            return True
        except Exception as e:  # noqa: BLE001  any failure of the side sink
            told = self.journal.spark.createDataFrame([(batch, f"{type(e).__name__}: {e}"[:2000])], "batch long, reason string")
            told.write.mode("append").parquet(f"{self.journal.path}/failures")
            return False

    def missing(self) -> list[int]:
        return sorted(set(self.journal.done("events")) - set(self.journal.done("alerts")))

    def retry(self) -> list[int]:
        """Tries the batches without alerts again; those that still have none."""
        return [b for b in self.missing() if not self.alert(b)]
