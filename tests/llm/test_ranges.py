"""Parts by ranges of a key: as many as the rows ask for, in order, at any number of bounds that the driver may hold."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pricelens.llm import fingerprint, sharding

SCHEMA = "doc_id long, text string"


def table(spark, n=600, seed=3):
    rng = random.Random(seed)
    keys = [None] * 40 + [77] * (n // 3) + [rng.randrange(-500, 500) for _ in range(n)]
    rows = [(k, f"w{i % 97} x{i} y{rng.randrange(9)}") for i, k in enumerate(keys)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("level", [1, 3, 8, 4096])
def test_parts(spark, level):
    rows = table(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    tied = sharding.by_range(df, "doc_id", "part", tie=F.xxhash64("text"), part_rows=10, level=level).withColumn("tie", F.xxhash64("text")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in tied) == sorted((k or 0, t) for k, t in rows)
    parts = defaultdict(list)
    for r in tied:
        parts[r.part].append((r.doc_id is not None, r.doc_id or 0, r.tie))
    spans = [(min(v), max(v)) for _, v in sorted(parts.items())]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert max(map(len, parts.values())) <= 40
    whole = sharding.by_range(df, "doc_id", "part", part_rows=10, level=level).collect()
    homes = defaultdict(set)
    for r in whole:
        homes[r.doc_id].add(r.part)
    assert all(len(v) == 1 for v in homes.values()) and len(set.union(*homes.values())) > 25
    ordered = sorted(homes, key=lambda k: (k is not None, k or 0))
    assert [min(homes[k]) for k in ordered] == sorted(min(homes[k]) for k in ordered)


def test_bounds_by_join(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BROADCAST", 0)
    df = spark.createDataFrame(table(spark), SCHEMA)
    joined = sharding.by_range(df, "doc_id", "part", tie=F.xxhash64("text"), part_rows=10, level=3)
    monkeypatch.undo()
    sent = sharding.by_range(df, "doc_id", "part", tie=F.xxhash64("text"), part_rows=10, level=3)
    assert joined.exceptAll(sent).count() == 0 and joined.count() == sent.count()


@pytest.mark.parametrize("level", [1, 5, 4096])
def test_next_row(spark, level):
    rows = table(spark, 200)
    df = spark.createDataFrame(rows, SCHEMA)
    tie = {r.text: r.tie for r in df.select("text", F.xxhash64("text").alias("tie")).collect()}
    got = fingerprint.next_of(df, ["text"], df, part_rows=5, level=level).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    following = {a[1]: b[1] for a, b in zip(order, [*order[1:], order[0]])}
    assert len(got) == len(rows) and {r.text: r.next_text for r in got} == following


def test_few_rows(spark):
    for rows in ([], [(None, "a")], [(5, "a")], [(None, "a"), (None, "a"), (1, "b")]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert sharding.by_range(df, "doc_id", "part", tie=F.xxhash64("text"), part_rows=1, level=2).count() == len(rows)
        assert fingerprint.next_of(df, ["text"], df, part_rows=1, level=2).count() == len(rows)
