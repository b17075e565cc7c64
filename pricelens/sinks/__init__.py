"""Changes to the domain's tables, each as a new table from the old one and what comes in; and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, incoming: DataFrame, key: str, order: str, mutable: Sequence[str]) -> DataFrame:
    """table with incoming rows of its columns: a known key takes the mutable columns of its last row (by order), a new one its last row.
    A null order comes before all others. Rows of a null key are left out."""
    last = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*table.columns), F.struct(F.col(order).isNotNull(), order)).alias("_new"))
    known = F.coalesce(F.col("_known"), F.lit(False))
    rows = table.withColumn("_known", F.lit(True)).join(last, key, "full")
    columns = [F.when(known & ((F.lit(c not in mutable)) | F.col("_new").isNull()), F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c) for c in table.columns if c != key]
    return rows.select(key, *columns).select(table.columns)


def link_matches(offers: DataFrame, references: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offers and references after the decisions of layer AUTO: an offer without product takes the reference; a reference's offre_ids get each offer once."""
    auto = decisions.where("layer = 'AUTO'").select("offre_id", "reference_id", "score")
    linked = offers.join(auto, "offre_id", "left")
    linked = linked.withColumn("produit_id", F.coalesce("produit_id", "reference_id")).drop("reference_id", "score")
    added = auto.groupBy("reference_id").agg(F.array_sort(F.collect_set("offre_id")).alias("_added"))
    held = F.coalesce("offre_ids", F.array().cast("array<long>"))
    named = references.join(added, "reference_id", "left").withColumn("offre_ids", F.concat(held, F.array_except(F.coalesce("_added", F.array().cast("array<long>")), held))).drop("_added")
    return linked, named


def add_candidates(table: DataFrame, decisions: DataFrame) -> DataFrame:
    """table (offre_id, reference_id, score, statut, commentaire) with the decisions of layer REVIEW whose pair it does not have, their signals as JSON."""
    signals = F.to_json(F.struct("reason", "s_model", "s_spec", "s_semantic", "s_name"))
    new = decisions.where("layer = 'REVIEW'").select("offre_id", "reference_id", "score", F.lit("INCERTAIN").alias("statut"), signals.alias("commentaire"))
    return table.unionByName(new.dropDuplicates(["offre_id", "reference_id"]).join(table.select("offre_id", "reference_id"), ["offre_id", "reference_id"], "left_anti"))


def delete_offers(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each of tables (with an offre_id) without the rows of the offers in gone."""
    ids = gone.select("offre_id").distinct()
    return {name: df.join(ids, "offre_id", "left_anti") for name, df in tables.items()}


def write_buckets(decisions: DataFrame, path: str, fields: Sequence[str], by: str = "layer") -> None:
    """The fields as CSV files with a header, in a folder for each layer."""
    decisions.select(by, *fields).write.partitionBy(by).option("header", True).option("encoding", "UTF-8").mode("overwrite").csv(path)


def watched(runs: DataFrame, activity: DataFrame, now: str, idle: int = 60, young: int = 120) -> DataFrame:
    """runs (run_id, date_debut, statut) with the status that a watchdog gives running ones when all queues are empty: TERMINE after idle
    seconds without activity (run_id, last_at), ECHOUE if there never was any and the run is as old as young seconds."""
    since = lambda c: F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col(c).cast("timestamp"))
    rows = runs.join(activity, "run_id", "left")
    active = F.col("statut") == "EN_COURS"
    status = F.when(active & F.col("last_at").isNull() & (since("date_debut") >= young), "ECHOUE").when(active & (since("last_at") >= idle), "TERMINE").otherwise(F.col("statut"))
    return rows.withColumn("statut", status).drop("last_at")
