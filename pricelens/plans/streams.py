"""Streams replayed over the given tables: what comes out of a stream in batches equals what a query gives at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..registry import query
from ..sinks.incremental import EventSinks, Journal, UpsertTable
from ..streaming import stateful
from ..tables import Tables
from .activity import FANNED
from .catalog import double

LOTS = 3


def in_lots(t: Tables) -> DataFrame:
    """Observations with lot, a third of the time from the first to the last each."""
    rows = t.observations.select("offre_id", F.col("observed_at").cast("timestamp").alias("observed_at"), "k1", "k2", double("prix_original"), double("prix_en_promotion"), "stock_status")
    at = F.unix_seconds("observed_at")
    span = t.raw("lineitem").agg(F.struct(F.min(F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("low"), F.max(F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("high"))).scalar()
    share = (at - span["low"]) / (span["high"] - span["low"] + 1)
    return rows.withColumn("lot", F.floor(share * LOTS).cast("int"))


def replay(spark: SparkSession, source: DataFrame, name: str, start) -> str:
    """Runs a stream over the lots of source, one after the other, each as a query of its own from the same checkpoint. start(stream, folder) gives its writer. Returns the folder."""
    folder = storage.shared_folder(spark, name)
    held = storage.written(source, f"{folder}/held", "lot")
    for k in range(LOTS):
        held.where(F.col("lot") == k).drop("lot").write.mode("append").parquet(f"{folder}/source")
        stream = spark.readStream.schema(held.drop("lot").schema).parquet(f"{folder}/source")
        start(stream, folder).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return folder


@query("SELECT offre_id, run, type_evenement, CAST(valeur_avant AS DOUBLE) AS valeur_avant, CAST(valeur_apres AS DOUBLE) AS valeur_apres, date_detection FROM fx_event")
def streamed_events(t: Tables) -> DataFrame:
    """The events of all observations, told by a stream that gets them in three batches and is started anew for each."""

    def start(stream: DataFrame, folder: str):
        told = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
        return stream.writeStream.foreachBatch(stateful.Folded(t.spark, f"{folder}/open", told))

    folder = replay(t.spark, in_lots(t), "events", start)
    rows = t.spark.read.parquet(f"{folder}/out")
    return rows.select("offre_id", "run", "type_evenement", "valeur_avant", "valeur_apres", F.col("date_detection").cast("timestamp_ntz").alias("date_detection"))


@query("""
SELECT k, least(n, 3) AS vues, CAST(prix AS DOUBLE) AS prix FROM (SELECT l_partkey % 500 AS k, count(DISTINCT CASE WHEN l_shipdate <= q.a THEN 0 WHEN l_shipdate <= q.b THEN 1 ELSE 2 END) AS n, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS prix
FROM lineitem, (SELECT TIMESTAMP '1994-06-30' AS a, TIMESTAMP '1996-06-30' AS b) q GROUP BY 1)""")
def streamed_upserts(t: Tables) -> DataFrame:
    """A table of the last price of each of 500 keys, upserted by a stream in three batches, each of which comes twice; vues counts the batches that touched the key."""
    at = F.col("l_shipdate").cast("timestamp_ntz")
    lot = F.when(at <= F.lit("1994-06-30").cast("timestamp_ntz"), 0).when(at <= F.lit("1996-06-30").cast("timestamp_ntz"), 1).otherwise(2)
    rows = t.raw("lineitem").select((F.col("l_partkey") % 500).cast("long").alias("k"), F.col("l_extendedprice").cast("double").alias("prix"), F.struct(at.cast("timestamp").alias("at"), "l_orderkey", "l_linenumber").alias("vu"), lot.alias("lot"))
    table: list[UpsertTable] = []

    def start(stream: DataFrame, folder: str):
        target = UpsertTable(t.spark, f"{folder}/table", "k long, prix double, vues int", "k", 8)
        table[:] = [target]

        def batch(rows: DataFrame, number: int) -> None:
            held = target.read().select("k", F.col("vues").alias("_vues"))
            last = rows.groupBy("k").agg(F.max_by("prix", "vu").alias("prix"), F.max("vu").alias("vu")).join(held, "k", "left")
            for _ in range(2):
                target.apply(last.select("k", "prix", (F.coalesce("_vues", F.lit(0)) + 1).alias("vues"), "vu"), number, "vu", ["prix", "vues"])

        return stream.writeStream.foreachBatch(batch)

    replay(t.spark, rows, "upserts", start)
    return table[0].read().select("k", F.col("vues").cast("long").alias("vues"), "prix")


@query(f"SELECT offre_id, run, rule_id, user_id FROM ({FANNED})")
def streamed_alerts(t: Tables) -> DataFrame:
    """The notifications of all events that a stream tells, though the sink of alerts fails once: the events are kept and their alerts made up for."""
    from ..operators import events as E

    schema = "offre_id long, run long, type_evenement string, valeur_avant double, valeur_apres double, date_detection timestamp"
    failures = [RuntimeError("the sink of alerts is down")]
    sinks: list[EventSinks] = []

    def alerts(rows: DataFrame) -> DataFrame:
        if failures:
            raise failures.pop()
        return E.fan_out(t.with_offer(rows).join(t.products, "produit_id"), t.scopes, t.rules, t.users).select("offre_id", "run", "rule_id", "user_id")

    def start(stream: DataFrame, folder: str):
        sinks[:] = [EventSinks(Journal(t.spark, f"{folder}/journal"), schema, alerts)]
        told = lambda rows, batch: sinks[0](rows.select(*(c.split()[0] for c in schema.split(", "))), batch)
        return stream.writeStream.foreachBatch(stateful.Folded(t.spark, f"{folder}/open", told))

    replay(t.spark, in_lots(t), "alerts", start)
    left = sinks[0].retry()
    if left:
        raise RuntimeError(f"batches without alerts: {left}")
    return sinks[0].journal.rows("alerts", "offre_id long, run long, rule_id long, user_id long")
