"""Sinks against hand-written cases, and the streaming twins against the batch operators."""

import datetime as dt

from pyspark.sql import functions as F

from pricelens import sinks, streaming


def test_sinks(spark, tmp_path):
    decided = spark.createDataFrame([(1, 7, 0.9, "AUTO", "", 1.0), (2, 8, 0.5, "REVIEW", "model<0.97", 0.2), (3, 8, 0.1, "NO_MATCH", "", 0.0)], "offre_id long, reference_id long, score double, layer string, reason string, s_model double")
    decided = decided.withColumns({c: F.lit(0.5) for c in ("s_spec", "s_semantic", "s_name")})
    offers = spark.createDataFrame([(1, None), (2, 5), (3, None)], "offre_id long, produit_id long")
    references = spark.createDataFrame([(7, [1]), (8, None)], "reference_id long, offre_ids array<long>")
    linked, named = sinks.link_matches(offers, references, decided)
    assert sorted(map(tuple, linked.collect())) == [(1, 7), (2, 5), (3, None)]
    assert {r.reference_id: r.offre_ids for r in named.collect()} == {7: [1], 8: []}
    empty = spark.createDataFrame([], "offre_id long, reference_id long, score double, statut string, commentaire string")
    once = sinks.add_candidates(empty, decided)
    assert [(r.offre_id, r.statut) for r in sinks.add_candidates(once, decided).collect()] == [(2, "INCERTAIN")] and '"s_model":0.2' in once.head().commentaire
    left = sinks.delete_offers(spark.createDataFrame([(1,)], "offre_id long"), offers=offers, decided=decided)
    assert (left["offers"].count(), left["decided"].count()) == (2, 2)
    sinks.write_buckets(decided, str(tmp_path / "b"), ["offre_id", "score"])
    assert spark.read.option("header", True).csv(str(tmp_path / "b")).groupBy("layer").count().count() == 3


def test_null_order_is_the_first(spark):
    table = spark.createDataFrame([(1, "old", 1.0)], "k long, nom string, prix double")
    rows = spark.createDataFrame([(2, "new", 3.0, None), (1, "a", 5.0, None), (1, "b", 6.0, 1), (None, "c", 1.0, 1)], "k long, nom string, prix double, seen long")
    assert sorted(map(tuple, sinks.upsert(table, rows, "k", "seen", ["prix"]).collect())) == [(1, "old", 6.0), (2, "new", 3.0)]


def test_seen_once(spark, tmp_path):
    schema = "url string, at timestamp"
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("a", at), ("a", at), ("b", at)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    streaming.first_seen(stream, "url", "at").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.url for r in spark.table("seen").collect()) == ["a", "b"]
