"""The one-stage matcher against all pairs of a brand, and what it moves."""

from pyspark.sql import functions as F

from pricelens.operators import matching

SHEET = "offre_id long, marque_slug string, nom string, specs map<string,string>, models array<string>"
OFFERS = [
    (1, "b", "lamp a1 x", {"ram": "8"}, ["mx123"]),
    (2, "b", "lamp a1 x", {"ram": "16"}, ["mx124"]),  # its model's references conflict
    (3, "b", "lamp", {"k": "1"}, []),
    (4, "b", "other", {}, ["qq9"]),  # no reference with this model
    (5, "none", "lamp", {"ram": "8"}, ["mx123"]),
    (6, "b", "lamp 8 gb", {"ram": "8"}, ["abcdefghijklmno"]),  # one letter more is almost alike
    (7, "b", None, None, ["mx123", "mx124"]),
]
REFERENCES = [
    (19, "b", "lamp a1 x", {"ram": "8"}, ["mx123"]), (11, "b", "lamp a1 x", {"ram": "8"}, ["mx123"]),
    (12, "b", "zzz", {"ram": "8", "gpu": "1"}, ["mx124"]), (13, "b", "lamp a1 x", {"ram": "16"}, ["mx1244"]),
    (14, "b", "lamp", {"k": "1"}, []), (15, "b", "lamp 8 gb", {"ram": "8"}, ["abcdefghijklmnop"]),
    (16, "b", "lamp 9 gb", {"ram": "9"}, ["abcdefghijklmno"]), (17, "b", "lamp", {"k": "1"}, []), (-3, "c", "lamp", {"ram": "8"}, ["mx123"]),
]


def test_best_of_all_pairs(spark):
    offers, references = spark.createDataFrame(OFFERS, SHEET), spark.createDataFrame(REFERENCES, SHEET).withColumnRenamed("offre_id", "reference_id")
    pairs = offers.select("offre_id", "marque_slug").join(references.select("reference_id", "marque_slug"), "marque_slug").select("offre_id", "reference_id", F.lit(0.0).alias("s_semantic"), F.col("reference_id").alias("rank"), F.lit(True).alias("relaxed"))
    wanted = matching.decided(matching.scored(pairs, offers, references, matching.ONE_STAGE_PROFILE, matching.ONE_STAGE), matching.ONE_STAGE_PROFILE)
    got = matching.one_stage(offers, references)
    told = ("offre_id", "reference_id", "score", "s_model", "s_spec", "s_name", "n_hard", "layer", "reason")
    rows = lambda df: sorted(map(tuple, df.select(*told).collect()))
    assert rows(got) == rows(wanted) and len(rows(got)) == 6
    assert {r.offre_id: r.reference_id for r in got.collect()}[1] == 11


def test_pairs_do_not_move(spark):
    """No exchange or sort lies between a brand's pairs and an offer's best."""
    offers, references = spark.createDataFrame(OFFERS, SHEET), spark.createDataFrame(REFERENCES, SHEET).withColumnRenamed("offre_id", "reference_id")
    pairs = offers.select("offre_id", "marque_slug", *(F.col(c).alias(f"{c}_a") for c in ("nom", "specs", "models"))).join(references.select("reference_id", "marque_slug", *(F.col(c).alias(f"{c}_b") for c in ("nom", "specs", "models"))).hint("shuffle_hash"), "marque_slug")
    lines = matching.best_pairs(pairs, matching.ONE_STAGE_PROFILE)._jdf.queryExecution().executedPlan().toString().split("\n")
    join = next(i for i, x in enumerate(lines) if "ShuffledHashJoin" in x)
    above = [x for x in lines[:join] if "Exchange" in x or "Sort" in x]
    assert len(above) == 1 and "offre_id" in above[0] and any("partial_max" in x for x in lines[lines.index(above[0]) : join])
