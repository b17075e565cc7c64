"""Batch stages that can be run again: they take the rows that have no result yet, lot by lot, and go on where a lost run ended.

At path lie the rounds of a stage. A round fixes the rows that it takes, dealt to lots by a hash of the
key; a lot's results count once its marker is there, and are overwritten where it is not. Rows whose
work fails are put aside with the reason, and come again in later rounds until they have failed as
often as they may.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..sinks.incremental import batches, commit


@dataclass
class Stage:
    """results: the columns that work adds to the key, as a schema. attempts: how often a row may fail."""

    spark: SparkSession
    path: str
    key: str
    results: str
    attempts: int = 3

    def taken(self) -> DataFrame:
        """key, results, reason, round of all rows of lots that count."""
        schema = f"{self.key} string, {self.results}, reason string, round long"
        held = [f"{self.path}/round-{r}/rows/lot={k}" for r in batches(self.spark, f"{self.path}/rounds") for k in batches(self.spark, f"{self.path}/round-{r}/done")]
        return self.spark.read.schema(schema).parquet(*held) if held else self.spark.createDataFrame([], schema)

    def done(self) -> DataFrame:
        """key and results of the rows that have them."""
        return self.taken().where("reason is null").drop("reason", "round")

    def quarantine(self) -> DataFrame:
        """key, failures and last reason of the rows that have no result."""
        rows = self.taken()
        failed = rows.where("reason is not null").groupBy(self.key).agg(F.count("*").alias("failures"), F.max_by("reason", "round").alias("reason"))
        return failed.join(self.done().select(self.key), self.key, "left_anti")

    def pending(self, rows: DataFrame) -> DataFrame:
        """rows without a result that may still be tried."""
        own = F.col(self.key).cast("string")
        stop = self.done().select(self.key).unionByName(self.quarantine().where(F.col("failures") >= self.attempts).select(self.key)).withColumnRenamed(self.key, "_key")
        return rows.where(own.isNotNull()).join(stop, own == F.col("_key"), "left_anti")

    def run(self, rows: DataFrame, work: Callable[[DataFrame], DataFrame], lots: int = 8) -> int:
        """Works on the pending rows, or on those of a round that was lost; how many rows it took. work gives the key, the results and a
        reason (null if good) of the rows of a lot; those that it leaves out are pending still."""
        rounds = batches(self.spark, f"{self.path}/rounds")
        number = len(rounds) - 1
        if not rounds or len(batches(self.spark, f"{self.path}/round-{number}/done")) == self.lots_of(number):
            left = self.pending(rows)
            if left.isEmpty():
                return 0
            number += 1
            lot = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(lots)).cast("int")
            plan = f"{self.path}/round-{number}/plan"
            left.withColumn("lot", lot).write.partitionBy("lot").mode("overwrite").parquet(plan)
            commit(self.spark, self.spark.createDataFrame([(lots,)], "lots int"), f"{self.path}/rounds/batch-{number}")
        held = self.spark.read.parquet(f"{self.path}/round-{number}/plan")
        n, finished = 0, set(batches(self.spark, f"{self.path}/round-{number}/done"))
        names = [x.split()[0] for x in self.results.split(", ")]
        for k in range(self.lots_of(number)):
            if k in finished:
                continue
            mine = held.where(F.col("lot") == k).drop("lot")
            at = f"{self.path}/round-{number}/rows/lot={k}"
            work(mine).select(F.col(self.key).cast("string").alias(self.key), *names, F.col("reason").cast("string").alias("reason"), F.lit(number).cast("long").alias("round")).write.mode("overwrite").parquet(at)
            taken = self.spark.read.parquet(at).count()
            commit(self.spark, self.spark.createDataFrame([(taken,)], "n long"), f"{self.path}/round-{number}/done/batch-{k}")
            n += taken
        return n

    def lots_of(self, number: int) -> int:
        return self.spark.read.parquet(f"{self.path}/rounds/batch-{number}").head().lots


def clear(stage: Stage) -> None:
    """Forgets all that the stage has done."""
    storage.remove(stage.spark, stage.path)
