"""Queries over changed tables: upserts, links of matches, the watchdog, and the assistant's memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import sinks
from ..registry import query
from ..tables import Tables


@query("""
SELECT CAST(p_partkey AS BIGINT) AS k, CASE WHEN p_partkey % 3 > 0 THEN p_name ELSE 'neuf' END AS nom, CASE WHEN p_partkey % 2 = 0 THEN 2.0 ELSE CAST(p_retailprice AS DOUBLE) END AS prix FROM part WHERE p_partkey % 3 > 0 OR p_partkey % 2 = 0""")
def upserted_offers(t: Tables) -> DataFrame:
    """Two of three parts are known; every second comes in twice with another name and price: known ones change their price only."""
    part = t.raw("part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_name").alias("nom"), F.col("p_retailprice").cast("double").alias("prix"))
    incoming = part.where("k % 2 = 0").select("k", F.lit("neuf").alias("nom"), F.explode(F.array(F.lit(1.0), F.lit(2.0))).alias("prix")).withColumn("seen", F.col("prix"))
    return sinks.upsert(part.where("k % 3 > 0"), incoming, "k", "seen", ["prix"])


@query("""
SELECT r AS reference_id, array_to_string(list_sort(list(o)), ',') AS ids FROM (SELECT 1 + p_partkey % 50 AS r, CAST(p_partkey AS BIGINT) AS o FROM part WHERE p_partkey % 4 > 0 UNION SELECT CAST(unnest(range(1, 51)) AS BIGINT), 1) GROUP BY r""")
def linked_references(t: Tables) -> DataFrame:
    """References with the offers that were linked to them added to what they had."""
    offers = t.raw("part").select(F.col("p_partkey").cast("long").alias("offre_id"), F.lit(None).cast("long").alias("produit_id"))
    references = t.spark.range(1, 51).select(F.col("id").alias("reference_id"), F.array(F.lit(1).cast("long")).alias("offre_ids"))
    decided = offers.select("offre_id", (1 + F.col("offre_id") % 50).alias("reference_id"), F.lit(1.0).alias("score"), F.when(F.col("offre_id") % 4 > 0, "AUTO").otherwise("REVIEW").alias("layer"))
    return sinks.link_matches(offers, references, decided)[1].select("reference_id", F.array_join(F.array_sort("offre_ids").cast("array<string>"), ",").alias("ids"))


@query("""
SELECT run_id, CASE WHEN statut = 'EN_COURS' THEN CASE WHEN run_id % 2 = 0 THEN 'TERMINE' ELSE 'ECHOUE' END ELSE statut END AS statut FROM fx_session""")
def watchdog_runs(t: Tables) -> DataFrame:
    """The status of all runs after a watchdog has looked; every second run told of activity, five minutes after it began."""
    seen = t.runs.where("run_id % 2 = 0").select("run_id", (F.col("date_debut") + F.expr("INTERVAL 5 MINUTES")).cast("timestamp").alias("last_at"))
    return sinks.watched(t.runs, seen, "2100-01-01 00:00:00").select("run_id", "statut")


@query("""
SELECT conv_id, turn, n > 4 AS to_summary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) WHERE total > 5""")
def memory_compaction(t: Tables, threshold: int = 5, keep: int = 4) -> DataFrame:
    """Messages of conversations of more than threshold: the last ones stay, the others go into a summary."""
    sizes = t.raw("conversations").groupBy("conv_id").agg(F.count("*").alias("_total")).where(F.col("_total") > threshold)
    by = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = t.raw("conversations").join(sizes, "conv_id").withColumn("_n", F.row_number().over(by))
    return rows.select("conv_id", "turn", (F.col("_n") > keep).alias("to_summary"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 10")
def conversation_history(t: Tables, limit: int = 10) -> DataFrame:
    """The last messages of each conversation, oldest first."""
    by = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t.raw("conversations").withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= limit).orderBy("conv_id", "turn").select("conv_id", "turn", "role")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def capped_facts(t: Tables, most: int = 20) -> DataFrame:
    """The newest facts of each user, as many as are kept."""
    by = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.raw("events").withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most).select("user_id", "event_id")
