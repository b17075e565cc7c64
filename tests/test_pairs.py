"""Pairs scored where their sides meet, against the same scores pair by pair."""

import random

import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from pricelens import plans, registry  # noqa: F401
from pricelens.operators import matching, pairs
from pricelens.tables import Tables

OFFER = "offre_id long, marque_slug string, categorie_id long, vector array<double>, nom string, specs map<string,string>, models array<string>"
CATEGORIES = [(1, 100), (2, 100), (3, None), (4, 101)]
TOLD = ("offre_id", "reference_id", "score", "s_semantic", "s_model", "s_spec", "s_name", "n_common", "n_conflict", "n_hard", "margin", "layer", "reason", "relaxed")


def listed_rows(n, seed):
    """Rows with copies, long names, several models, odd sheets, and brands without any vector."""
    rng = random.Random(seed)
    words = ["lenovo", "pc", "été", "8 Go", "16 Go", "x" * 70, "slim", "15iru8"]
    maps = [None, {}, {"ram": "8gb", "gpu": None}, {"ram": "16gb", "gpu": "rtx"}, {"ram": "8gb", "k": "1"}, {"disque dur": "1tb", "k": "2", "ram": "8gb"}]
    models = [None, [], ["15iru8"], ["15iru9", "zz1"], ["15iru8", "abcdefghijk"], ["q" * 66]]
    pick = lambda x: x[rng.randrange(len(x))]
    vector = lambda brand: None if brand == "n" or rng.random() < 0.1 else [float(rng.randrange(3)), float(rng.randrange(3)), 1.0]
    out = []
    for k in range(n):
        brand = pick(["a", "a", "b", "n", None])
        out.append((seed * 1000 + k, brand, rng.randrange(1, 6), vector(brand), None if rng.random() < 0.1 else " ".join(pick(words) for _ in range(rng.randrange(5))), pick(maps), pick(models)))
    return out


def rows_of(df):
    return sorted(map(tuple, df.select(*TOLD).collect()), key=lambda r: r[0])


def test_matched_is_decided_pair_by_pair(spark):
    offers = spark.createDataFrame(listed_rows(90, 1), OFFER)
    references = spark.createDataFrame(listed_rows(60, 2), OFFER).withColumnRenamed("offre_id", "reference_id")
    categories = spark.createDataFrame(CATEGORIES, "categorie_id long, parent_id long")
    wanted = rows_of(matching.decided(matching.scored(matching.candidates(offers, references, categories), offers, references)))
    got = rows_of(matching.matched(offers, references, categories))
    assert got == wanted and len({r[0] for r in got}) > 70 and {r[-1] for r in got} == {True, False}


def test_blocks_give_the_same(spark):
    asking = spark.createDataFrame(listed_rows(60, 3), OFFER).withColumn("key", F.col("marque_slug"))
    others = spark.createDataFrame(listed_rows(50, 4), OFFER).select(F.col("offre_id").alias("id"), F.col("marque_slug").alias("key"), "nom", "specs", "models", F.lit(0.5).alias("s_semantic"), F.col("offre_id").alias("rank"), F.lit(False).alias("relaxed"))
    scale = matching.scale(matching.ONE_STAGE)
    found = lambda block: rows_of(matching.decided(matching.facts(pairs.best(matching.asking_side(asking), matching.other_side(others, matching.COMPUTERS), 2, scale, block))))
    whole = found(1000)
    assert found(7) == whole and len(whole) == asking.where("marque_slug is not null").count()


def test_texts_are_held_against_each_other_at_once(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (0, 1, 5, 40, 63, 64, 65, 128, 129, 200) for _ in range(8)]
    a, b = (np.array([rng.randrange(len(texts)) for _ in range(900)]) for _ in range(2))
    wanted = [matching.ratio(texts[x], texts[y]) for x, y in zip(a, b, strict=True)]
    for most in (pairs.PLACES, 5000):
        monkeypatch.setattr(pairs, "PLACES", most)
        t = pairs.Texts(texts)
        assert t.ratio(t.number[a], t.number[b]).tolist() == wanted


def test_scores_are_rounded_as_by_the_engine(spark):
    x = np.random.default_rng(1).integers(-20000, 20000, 500) / 20000 + np.random.default_rng(2).integers(0, 2, 500) * 1e-16
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 4)).collect()
    assert pairs.rounded(x).tolist() == [r[0] for r in got]


def test_pairs_of_the_cascade_do_not_move(spark):
    """No sheet is joined to a pair, and no function is called for each pair."""
    for name in ("match_decisions",):
        plan = registry.QUERIES[name](Tables(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "EvalPython" not in plan


def test_summary_takes_families_from_the_kept_sheets(spark):
    plan = registry.QUERIES["match_summary"](Tables(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "EvalPython" not in plan and "/embeddings.parquet" not in plan


def test_one_stage_on_odd_rows(spark):
    """The best of all pairs of a brand, whatever the rows lack; ids beyond 32 bits; no function is called for each pair."""
    offers = spark.createDataFrame(listed_rows(70, 6), OFFER)
    references = spark.createDataFrame(listed_rows(80, 7), OFFER).withColumn("offre_id", F.col("offre_id") + 2**40).withColumnRenamed("offre_id", "reference_id")
    both = offers.select("offre_id", "marque_slug").join(references.select("reference_id", "marque_slug"), "marque_slug")
    both = both.select("offre_id", "reference_id", F.lit(0.0).alias("s_semantic"), F.col("reference_id").alias("rank"), F.lit(True).alias("relaxed"))
    wanted = matching.decided(matching.scored(both, offers, references, matching.ONE_STAGE_PROFILE, matching.ONE_STAGE), matching.ONE_STAGE_PROFILE).withColumn("margin", F.lit(0.0))
    got = matching.one_stage(offers, references)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "EvalPython" not in plan
    assert rows_of(got.withColumn("margin", F.lit(0.0))) == rows_of(wanted)
