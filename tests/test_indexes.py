"""The inverted file, fixpoints over links, and phrases of a dictionary, against brute force."""

import random
import re

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from pricelens.operators import ann, dictionary, graph, nearest, normalizer
from pricelens.plans import documents
from pricelens.tables import Tables


def nearest_of(vectors, queries, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in queries:
        like = np.round(unit @ unit[q], 9)
        out[q] = [int(i) for i in np.lexsort((np.arange(len(like)), -like))[:k]]
    return out


def test_full_probes_are_exact_and_few_find_most(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    vectors = (centres[rng.integers(12, size=600)] + 0.3 * rng.normal(size=(600, 16))).round(3)
    items = spark.createDataFrame([(i, "g", v.tolist()) for i, v in enumerate(vectors)] + [(9999, "g", None)], "item_id long, group string, vector array<double>")
    queries = items.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    index = ann.build(items.where("item_id < 500"), str(tmp_path / "ann"), lists=20)
    ann.add(index, items.where("item_id >= 500"))
    index = ann.opened(spark, index.path)
    exact = nearest_of(vectors, range(0, 600, 20), 5)
    for probes, least in ((20, 1.0), (4, 0.9)):
        got = {}
        for r in sorted(ann.search(queries, index, 5, probes).collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append(r.item_id)
        assert np.mean([len(set(got[q]) & set(exact[q])) / 5 for q in exact]) >= least
    assert got != {} and all(len(x) == 5 for x in got.values())
    few = ann.probes_for(index, queries, 5, 0.95)
    assert 1 <= few <= 6 and ann.probes_for(index, queries, 5, 1.0) >= few
    with pytest.raises(Exception, match="vectors of"):
        ann.search(spark.createDataFrame([(1, "g", [1.0, 2.0])], queries.schema), index, 5, 4).collect()
    none = ann.build(items.where("vector is null"), str(tmp_path / "none"))
    assert ann.search(queries, none, 5).count() == 0


def test_recall_at_the_default_probes(spark):
    t = Tables(spark, SMALL)
    key = lambda rows: {(r.query_id, r.item_id) for r in rows.collect()}
    exact, few = key(documents.ann_search(t)), key(documents.ann_search(t, ann.PROBES))
    assert len(exact & few) >= 0.9 * len(exact)


def test_only_probed_folders_are_read(spark, tmp_path):
    items = spark.createDataFrame([(i, "g", [float(i % 9), 1.0, float(i % 5)]) for i in range(200)], "item_id long, group string, vector array<double>")
    index = ann.build(items, str(tmp_path / "ann"), lists=30)
    rows = ann.search(items.where("item_id = 3").withColumnRenamed("item_id", "query_id"), index, 3, 1)
    assert "PartitionFilters: [" in rows._jdf.queryExecution().executedPlan().toString().replace("PartitionFilters: []", "")


def test_a_query_of_several_groups(spark):
    """Each group of a query has neighbours and ranks of its own; copies of it in one group ask alike."""
    q = [(1, "a", [1.0, 0.0]), (1, "b", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (2, "c", [0.0, 1.0])]
    items = [(10, "a", [1.0, 0.1]), (11, "a", [0.0, 1.0]), (12, "b", [1.0, 1.0]), (13, "c", [0.0, 1.0]), (14, "b", [1.0, 0.0])]
    vector = "id long, group string, vector array<double>"
    got = nearest.nearest(spark.createDataFrame(q, vector).withColumnRenamed("id", "query_id"), spark.createDataFrame(items, vector).withColumnRenamed("id", "item_id"), 2).collect()
    wanted = [(1, 10, 1), (1, 11, 2), (1, 12, 2), (1, 14, 1), (2, 10, 1), (2, 11, 2), (2, 13, 1)]
    assert sorted((r.query_id, r.item_id, r["rank"]) for r in got) == wanted


def test_discovery_ends_in_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("a", "skip"), ("skip", "e"), ("b", "gone"), ("x", "y"), (None, "z"), ("a", None)]
    links = spark.createDataFrame(edges, "src string, dst string")
    pages = spark.createDataFrame([(x,) for x in "abcdexy"], "node string")
    roots = spark.createDataFrame([("a",), ("missing",), (None,)], "node string")
    got = sorted(map(tuple, graph.discover(links, roots, pages, F.col("dst") == "skip").collect()))
    assert got == [("a", 0, False), ("b", 1, False), ("c", 2, False), ("d", 3, True)]
    assert graph.reach(links, roots.select(F.lit(1).alias("root"), "node"), rounds=1).where("depth > 1").count() == 0


def test_closures(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 4), (6, 5), (10, 11), (11, 10)], "k long, up long")
    below = graph.descendants(tree, spark.createDataFrame([(1,), (4,), (10,), (99,)], "top long"), "k", "up")
    assert sorted(map(tuple, below.collect())) == [(1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 3), (1, 6, 4), (4, 5, 1), (4, 6, 2), (10, 11, 1)]
    above = {(r.k, r.ancestor): r.height for r in graph.ancestors(tree, "k", "up").collect()}
    assert above[6, 1] == 4 and above[5, 4] == 1 and (1, 1) not in above and above[10, 11] == 1


def test_phrases(spark):
    rng = random.Random(8)
    brands = ["hp", "lg", "lg electronics", "brand#1", "brand#12", "l'oréal", "yahoo!", "a b c", "!x", "é", "hp inc."]
    pieces = [*brands, *[b.upper() for b in brands], "hpx", "xhp", "-", " ", "  ", "\t", ".", "15", "brand#123", "electronics"]
    names = [None, "", " ", "HP", "hp-15", "shp", "LG  Electronics", "LG Electronics", "Brand#12 tv", "brand#1é", "yahoo!x", "Yahoo! x"] + ["".join(rng.choice([x, x + " "]) for x in rng.choices(pieces, k=rng.randrange(1, 8))) for _ in range(300)]
    texts = spark.createDataFrame(list(enumerate(names)), "k long, text string")
    got = {(r.k, r.phrase) for r in dictionary.phrases_in(texts, spark.createDataFrame([(b,) for b in brands], "phrase string"), "k").collect()}
    wanted = {(k, b) for k, n in enumerate(names) if n for b in brands if re.search(r"(?:^|[ \t\n\x0b\f\r])" + re.escape(b) + r"(?:[ \t\n\x0b\f\r]|$|[^a-z0-9])", n.lower())}
    assert got == wanted and len(got) > 300
    assert dictionary.phrases_in(texts, spark.createDataFrame([], "phrase string"), "k").count() == 0
    found = normalizer.brands_in_names(texts.select(F.col("k").alias("offre_id"), F.col("text").alias("nom")), spark.createDataFrame([(b,) for b in brands], "marque string"))
    longest = {r.offre_id: len(r.found) for r in found.collect()}
    assert longest == {k: max(len(b) for j, b in wanted if j == k) for k, _ in wanted}
