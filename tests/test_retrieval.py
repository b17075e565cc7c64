"""Chunks, full text, fusion and page parsing against hand-written cases."""

import math
import random

from pyspark.sql import functions as F

from pricelens.functions import pages
from pricelens.operators import retrieval, textindex


def test_chunks(spark):
    text = "Titre\n\n" + "Une phrase courte. " * 60 + "\n\n" + "x" * 1200
    got = retrieval.split(text)
    assert all(0 < len(c) <= 512 for c in got) and got[0].startswith("Titre") and "".join(got).count("x") >= 1200
    plain = " ".join(f"m{i}" for i in range(400))
    parts = retrieval.split(plain)
    assert [w for i, p in enumerate(parts) for w in p.split() if i == 0 or w not in parts[i - 1].split()] == plain.split()
    assert all(set(a.split()) & set(b.split()) for a, b in zip(parts, parts[1:]))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "court")], "document_id long, content string")
    rows = [(r.document_id, r.chunk_index, r.content) for r in retrieval.chunked(docs).orderBy("document_id", "chunk_index").collect()]
    assert rows == [(1, k, c) for k, c in enumerate(got)] + [(4, 0, "court")]


def test_fusion(spark):
    ranks = "query_id long, chunk_id long, rank int"
    meaning = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1)], ranks)
    keywords = spark.createDataFrame([(1, 12, 1), (1, 13, 2), (3, 30, 1), (3, 31, 2)], ranks)
    got = {}
    for r in retrieval.fused(meaning, keywords).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.search_type))
    assert [c for c, _ in got[1]] == [12, 10, 11, 13] and {k for _, k in got[1]} == {"hybrid"}
    assert got[2] == [(20, "semantic")] and got[3] == [(30, "keyword"), (31, "keyword")]
    assert retrieval.fused(meaning, keywords, limit=1).count() == 3


def test_full_text_wants_all_words(spark):
    chunks = spark.createDataFrame([(1, 1, "Les prix des téléphones baissent"), (2, 1, "Le prix du téléphone : prix en baisse"), (3, 2, "prix téléphone"), (4, 1, "prix")], "chunk_id long, tenant_id long, content string")
    queries = spark.createDataFrame([(7, 1, "Prix du téléphone"), (8, 1, "de la")], "query_id long, tenant_id long, text string")
    assert [(r.query_id, r.chunk_id, r["rank"]) for r in retrieval.by_keywords(queries, textindex.build(chunks)).orderBy("rank").collect()] == [(7, 2, 1), (7, 1, 2)]


def ts_rank(places):
    """The published formula, over the places of each lexeme."""
    if len(places) == 1:
        return sum(0.1 / (j + 1) ** 2 for j in range(len(places[0]))) / 1.64493406685
    left = 1.0
    for i, a in enumerate(places):
        for b in places[:i]:
            for p in a:
                for q in b:
                    w = abs(p - q)
                    left *= 1 if w == 0 else 1 - math.sqrt(0.01 * (1e-30 if w > 100 else 1 / (1.005 + 0.05 * math.exp(w / 1.5 - 2))))
    return 1 - left


def test_ranks_of_the_index(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = ["prix", "promo", "stock", "rupture", "télé", "de", "la", "x"]
    rows = [(k, k % 2, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 300)))) for k in range(30)] + [(30, 0, None), (31, 1, "")]
    chunks = spark.createDataFrame(rows, "chunk_id long, tenant_id long, content string")
    index = textindex.build(chunks.where("chunk_id < 20"), str(tmp_path / "index"))
    textindex.add(index, chunks.where("chunk_id >= 20"))
    queries = [(1, 0, "prix promo"), (2, 1, "rupture stock prix"), (3, 0, "la télé"), (4, 1, "x de la"), (5, 0, "absent prix")]
    got = {(r.query_id, r.chunk_id): r.score for r in textindex.search(spark.createDataFrame(queries, "query_id long, tenant_id long, text string"), index, 100).collect()}
    stem = lambda w: {"prix": "pri", "télé": "tel"}.get(w, w)
    wanted = {}
    for q, tenant, text in queries:
        asked = {stem(w) for w in text.split()} - {"de", "la", "x"}
        for i, t, content in rows:
            said = [stem(w) for w in (content or "").split()]
            places = [[p + 1 for p, w in enumerate(said) if w == x] for x in sorted(asked)]
            if t == tenant and asked and all(places):
                wanted[q, i] = ts_rank(places)
    assert set(got) == set(wanted) and all(abs(got[k] - wanted[k]) < 1e-8 for k in got) and len(got) > 20
    near = spark.createDataFrame([(9, 0, "stock de la rupture")], "query_id long, tenant_id long, text string")
    found = {r.chunk_id for r in textindex.phrase(near, index).collect()}
    assert found == {i for i, t, c in rows if t == 0 and any(a == "stock" and b == "rupture" for a, b in zip((c or "").split(), (c or "").split()[3:]))}
    plan = textindex.search(near, index)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#").replace("PartitionFilters: [isnotnull(bucket", "PartitionFilters: [bucket") or "PartitionFilters: [" in plan


def test_searches_move_each_posting_once(spark, tmp_path):
    """Many askings of the same common words: what moves is the postings, not a row for each of them and each asking."""
    chunks = spark.range(400).select(F.col("id").alias("chunk_id"), F.lit(0).cast("long").alias("tenant_id"), F.lit("rouge prix bleu prix vert").alias("content"))
    index = textindex.build(chunks, str(tmp_path / "many"))
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.lit(0).cast("long").alias("tenant_id"), F.lit("prix bleu").alias("text"))
    plan = textindex.search(queries, index, 2)
    assert "MapInArrow" in plan._jdf.queryExecution().toString()
    got = plan.collect()
    assert len(got) == 600 and {(r.chunk_id, r["rank"]) for r in got} == {(0, 1), (1, 2)}
    assert textindex.phrase(queries.where("query_id < 3"), index).count() == 1200
    assert textindex.phrase(queries.where("query_id < 3").withColumn("text", F.lit("bleu rouge")), index).count() == 0


HTML = """<a href="/a">A</a><a class="x" href="/a">again</a><a href="#top">t</a><a href="javascript:f()">j</a><a href="http://b/c?page=4">C &amp; D</a>
<h1>TV <b>55</b>&nbsp;pouces</h1><span class="price old">1.299,5 TND</span><dl><dt>Marque</dt><dd>LG</dd><dt>RAM</dt><dd>8 Go</dd><dt>Vide</dt></dl>
<script type="application/ld+json">{"name": "TV 55", "brand": {"name": "LG"}, "offers": {"price": "999.5"}}</script>"""


def test_pages(spark):
    bare = HTML[: HTML.index("<script")]
    rows = spark.createDataFrame([("http://s/l?page=2", HTML), ("http://s/l?page=4&q=1", bare), (None, None), ("http://s/", '<table><tr><th>Poids</th><td>2 kg</td></tr></table>{"')], "url string, html string")
    got = rows.select(
        pages.links(F.col("html"), F.col("url")).alias("l"), pages.next_page(F.col("url"), F.col("html")).alias("n"), pages.spec_sheet(F.col("html")).alias("s"), pages.product(F.col("html")).alias("p"),
        pages.embedded(F.col("html")).alias("e"), pages.stock_status(F.lit("Rupture de stock")).alias("st"), pages.image_id(F.lit("http://x/img/40511.jpg")).alias("i"),
    ).collect()
    assert [(x.url, x.name) for x in got[0].l] == [("http://s/a", "A"), ("http://b/c?page=4", "C & D")]
    assert got[0].n == "http://s/l?page=3" and got[1].n is None and got[2].n is None
    assert got[0].s == {"Marque": "LG", "RAM": "8 Go"} and got[2].s == {} and got[3].s == {"Poids": "2 kg"}
    assert tuple(got[0].p)[:3] == ("TV 55", 999.5, "LG") and tuple(got[1].p)[:3] == ("TV 55 pouces", 1299.5, None)
    assert got[3].e == "{}" and got[0].st == "RUPTURE" and got[0].i == "4051" and got[2].l == []
