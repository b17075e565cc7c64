"""Spec values and the matching cascade against hand-written cases."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from pricelens.functions import specs
from pricelens.operators import matching, nearest, normalizer

VALUES = [
    ("ram", "8 Go", "8gb"), ("ram", "8GB", "8gb"), ("stockage", "1 To", "1tb"), ("stockage", "1000 Go", "1tb"), ("stockage", "1024 Go", "1024gb"), ("stockage", "2000 Mo", "2gb"),
    ("frequence", "2,5 GHz", "2.5ghz"), ("frequence", "2500 MHz", "2.5ghz"), ("frequence", "800 MHz", "800mhz"), ("frequence", "3 GHz", "3ghz"),
    ("taille_ecran", "15,6 pouces", "15.6in"), ("taille_ecran", '15.6"', "15.6in"), ("taille_ecran", "15.6", "15.6in"), ("poids", "15.6", "15.6"),
    ("resolution", "1920 x 1080", "1920x1080"), ("resolution", "Full HD", "1920x1080"), ("resolution", "4K", "3840x2160"),
    ("couleur", " Noir ", "noir"), ("puissance", "65 Watts", "65w"), ("x", None, ""), ("x", "  ", ""),
]


def test_spec_values(spark):
    rows = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(VALUES)], "i int, k string, v string")
    got = {r.i: r.out for r in rows.select("i", specs.normalize_value(F.col("k"), F.col("v")).alias("out")).collect()}
    assert [got[i] for i in range(len(VALUES))] == [w for _, _, w in VALUES]


def test_keys_models_capacities(spark):
    one = spark.createDataFrame([({"Modèle": "SM-A556 128 Go", "Couleur": "Noir", "RAM": "8 Go", "Etat": "Autres"}, "Galaxy A55 128Go")], "fiche map<string,string>, nom string")
    match = lambda k, keys: specs.key_matches(F.lit(k), keys)
    r = one.select(
        match("Mémoire vive", ["ram"]).alias("a"), match("Taille de l'écran", ["taille_ecran"]).alias("b"), match("Carte graphique", ["gpu"]).alias("c"), match("Couleur", ["ram", "gpu"]).alias("d"), match("", ["ram"]).alias("e"),
        specs.model_slugs(F.col("fiche"), F.col("nom")).alias("m"), specs.model_slugs(F.create_map(F.lit("x"), F.lit("y")), F.lit("PC Lenovo 15IRU8 i5-1335U FHD A1 DDR4 X515EA"), True).alias("n"), specs.model_slug(F.lit("12345678")).alias("o"),
        specs.capacities(F.col("nom")).alias("p"), specs.normalize_specs(F.col("fiche"), ["couleur"]).alias("q"), specs.canonical_json(F.create_map(F.lit(" B "), F.lit("X"), F.lit("a"), F.lit(None).cast("string"))).alias("s"),
    ).head()
    assert (r.a, r.b, r.c, r.d, r.e) == (True, True, True, False, False)
    assert r.m == ["sma556128gb"] and r.n == ["a1", "x515ea"] and r.o == "" and r.p == ["128gb"]
    assert r.q == {"modele": "128gb", "ram": "8gb"} and r.s == '{"b":"x"}'


def test_ratio_is_the_longest_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for a, b in [("abcbdab", "bdcaba"), ("", "a"), ("iphone15", "iphone15"), ("aaaa", "aa"), ("15iru8", "16iah8")]:
        assert matching.common_length(a, b) == slow(a, b)
    assert matching.ratio("", "") == 1.0 and matching.ratio("ab", "cd") == 0.0


OFFERS = "offre_id long, nom string, specs map<string,string>, models array<string>"
NAME = "Lenovo IdeaPad Slim 3 15IRU8 i5-1335U 8Go 512Go SSD"
SPECS, MODELS = {"ram": "8gb", "stockage": "512gb", "processeur": "i5-1335u"}, ["15iru8", "i51335u"]


@pytest.fixture(scope="module")
def scores(spark):
    offers = [
        (1, NAME, SPECS, MODELS),
        (2, NAME.replace("8Go", "16Go"), {**SPECS, "ram": "16gb"}, MODELS),
        (3, "Lenovo IdeaPad Slim 5 16IAH8 i7-12700H 16Go 1To", {"ram": "16gb"}, ["16iah8", "i712700h"]),
        (4, None, {}, []),
    ]
    references = spark.createDataFrame([(9, NAME, SPECS, MODELS)], OFFERS.replace("offre_id", "reference_id"))
    pairs = spark.createDataFrame([(i, 9, 0.95 if i < 3 else 0.80, 1, False) for i in range(1, 5)], "offre_id long, reference_id long, s_semantic double, rank int, relaxed boolean")
    return {r.offre_id: r for r in matching.decided(matching.scored(pairs, spark.createDataFrame(offers, OFFERS), references)).collect()}


def test_scores(scores):
    assert scores[1].score == round(0.40 + 0.25 + 0.20 * 0.95 + 0.15, 4) and scores[1].n_hard == 0 and scores[1].layer == "AUTO"
    assert scores[2].n_hard == 1 and scores[2].score < scores[1].score - 0.07
    assert scores[3].score < matching.COMPUTERS.auto and scores[3].layer != "AUTO"
    assert scores[4].score == round(0.20 * 0.80, 4) and scores[4].layer == "NO_MATCH"


def test_profiles_by_family(spark):
    """Offers of three families, one without a profile: each is scored and decided as by its own profile alone."""
    strict = dataclasses.replace(matching.COMPUTERS, name="strict", hard_keys=("stockage",), auto=0.99, review=0.9, margin=0.3, semantic=0.99)
    rows = [(k, NAME, {**SPECS, "ram": f"{4 * (k % 3)}gb", "taille": "9"}, MODELS, "ABC"[k % 3]) for k in range(9)]
    offers = spark.createDataFrame(rows, OFFERS + ", family string")
    references = spark.createDataFrame([(90, NAME, {**SPECS, "taille": "8"}, MODELS), (91, NAME.replace("8Go", "16Go"), SPECS, MODELS)], OFFERS.replace("offre_id", "reference_id"))
    pairs = spark.createDataFrame([(k, r, 0.95, r - 89, False) for k in range(9) for r in (90, 91)], "offre_id long, reference_id long, s_semantic double, rank int, relaxed boolean")
    table = matching.profile_table(spark, {"A": matching.COMPUTERS, "B": strict})
    facts = lambda df: {r.offre_id: (r.reference_id, r.score, r.margin, r.n_hard, r.layer, r.reason) for r in df.collect()}
    got = facts(matching.decided(matching.scored(matching.profiled(pairs, offers, table), offers, references)))
    wanted = {}
    for family, profile in (("A", matching.COMPUTERS), ("B", strict), ("C", matching.Profile())):
        own = pairs.join(offers.where(offers.family == family).select("offre_id"), "offre_id")
        wanted |= facts(matching.decided(matching.scored(own, offers, references, profile), profile))
    assert got == wanted and len({v[4:] for v in got.values()}) > 1


def test_capacity_mismatch_and_margin(spark):
    names = {1: "Apple iPhone 15 128Go Noir", 2: "Apple iPhone 15 256Go Noir"}
    offers = spark.createDataFrame([(1, names[1], {}, ["iphone15"])], OFFERS)
    references = spark.createDataFrame([(k, n, {}, ["iphone15"]) for k, n in names.items()], OFFERS.replace("offre_id", "reference_id"))
    pairs = spark.createDataFrame([(1, k, 0.95, k, False) for k in names], "offre_id long, reference_id long, s_semantic double, rank int, relaxed boolean")
    rows = matching.scored(pairs, offers, references, matching.Profile())
    got = {r.reference_id: r.score for r in rows.collect()}
    assert got[2] <= got[1] - 0.29
    best = matching.decided(rows, dataclasses.replace(matching.Profile(), auto=0.7, margin=0.9)).head()
    assert (best.reference_id, best.layer, best.reason) == (1, "REVIEW", "margin<0.9")


def test_candidates_relax_and_nearest_blocks(spark):
    row = "offre_id long, marque_slug string, categorie_id long, vector array<double>"
    offers = spark.createDataFrame([(1, "a", 10, [1.0, 0.0]), (2, "a", 30, [0.0, 1.0]), (3, "b", 10, [1.0, 0.0]), (4, "a", 10, None)], row)
    references = spark.createDataFrame([(7, "a", 11, [1.0, 0.1]), (8, "a", 12, [0.0, 1.0])], row.replace("offre_id", "reference_id"))
    categories = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (30, None)], "categorie_id long, parent_id long")
    got = {(r.offre_id, r.reference_id): r.relaxed for r in matching.candidates(offers, references, categories).collect()}
    assert got == {(1, 7): False, (2, 8): True, (2, 7): True, (4, 7): False}
    left = matching.unmatched(offers, spark.createDataFrame([(1,), (2,)], "offre_id long"), references)
    assert {r.offre_id: r.reason for r in left.collect()} == {3: "no_brand_in_referentiel", 4: "no_candidate_after_prefilter"}
    bare = references.withColumn("vector", F.when(F.col("reference_id") == 7, F.col("vector")))
    rows = {(r.offre_id, r.reference_id): r.s_semantic for r in matching.candidates(offers, bare, categories).collect()}
    assert set(rows) == {(1, 7), (2, 7), (4, 7)} and rows[4, 7] == 0.0  # a reference without vector stands back behind one with
    rows = {(r.offre_id, r.reference_id): (r.s_semantic, r.rank) for r in matching.candidates(offers, references.withColumn("vector", F.lit(None).cast("array<double>")), categories).collect()}
    assert rows == {(1, 7): (0.0, 1), (2, 7): (0.0, 1), (2, 8): (0.0, 2), (4, 7): (0.0, 1)}
    q = spark.createDataFrame([(i, "g", [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "query_id long, group string, vector array<double>")
    items = q.select(F.col("query_id").alias("item_id"), "group", "vector")
    rows = lambda block: sorted((r.query_id, r.rank, r.item_id, round(r.similarity, 9)) for r in nearest.nearest(q, items, 3, block).collect())
    assert rows(2048) == rows(7) and len(rows(7)) == 120


def test_normalizer(spark):
    offers = spark.createDataFrame(
        [
            (1, "HP Pavilion 15 i5-1240P", {"Marque :": " hp "}, "s", "http://c/1?p=2", None, None),
            (2, "Ecran LG UltraGear 27GN800", {"x": "1"}, "s", "http://c/1", None, 5),
            (3, "Galaxy Book RTX 4060 Ti", {"Brand": ""}, "t", None, "Samsung", None),
            (4, None, None, "s", "http://none", None, None),
        ],
        "offre_id long, nom string, fiche map<string,string>, site string, category_url string, marque string, categorie_id long",
    )
    brands = spark.createDataFrame([("HP",), ("LG",), ("LG Electronics",), ("Samsung",)], "marque string")
    keys = spark.createDataFrame([("s", "x", "ecran")], "site string, key string, canonical string")
    places = spark.createDataFrame([("s", "http://c/1", 7)], "site string, url string, categorie_id long")
    got = {r.offre_id: r for r in normalizer.normalize_offers(offers, brands, keys, places).collect()}
    assert (got[1].marque, got[1].categorie_id, got[1].specs) == ("HP", 7, {"Modèle": "i5-1240P"})
    assert (got[2].marque, got[2].categorie_id, got[2].specs) == ("LG", 5, {"ecran": "1"})
    assert (got[3].marque, got[3].categorie_id, got[3].specs) == ("Samsung", None, {"Modèle": "RTX 4060 Ti"})
    assert (got[4].marque, got[4].categorie_id, got[4].specs) == (None, None, {})
    assert normalizer.missing(normalizer.normalize_offers(offers, brands, keys, places)).count() == 2
    refs = normalizer.bootstrap(spark.createDataFrame([(1, None, "HP", 3, None), (2, "n", "LG", None, None), (3, "n", "LG", 4, 8)], "offre_id long, nom string, marque string, categorie_id long, produit_id long")).collect()
    assert [(r.reference_id, r.nom_produit, r.offre_ids) for r in refs] == [(1, "(sans nom)", [1])]


def test_copies_of_vectors_make_no_pairs(spark):
    n = 3000
    q = spark.range(n).select(F.col("id").alias("query_id"), F.lit("g").alias("group"), F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("vector"))
    items = q.select((F.col("query_id") + 10).alias("item_id"), "group", "vector")
    rows = nearest.nearest(q, items, 4, 2).collect()  # blocks of two: by copies there would be 2,250,000 of them
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.similarity))
    assert len(rows) == 4 * n and all(sorted(got[k]) == [(j + 1, 10 + k % 3 + 3 * j, 1.0) for j in range(4)] for k in range(n))


def test_products_do_not_meet_by_category(spark):
    from conftest import SMALL

    from pricelens.tables import Tables

    t = Tables(spark, SMALL)
    plan = t.listings._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(produit_id" in plan
