"""Filter interaction audit: what each of five filters removes in every order of application.

Filter E, exact copies, is an RDD routed by fingerprint. Each input partition first holds its texts
against each other, lot by lot: a copy of a smaller id within the lot is decided there, so a text that
many rows share leaves a lot once. What is left is partitioned by xxhash of the text and sorted by
fingerprint and id; a partition walks through it with one chain at a time, the distinct full texts of
a fingerprint with their minimum ids. Out come the facts of all documents, the non-minimum ones marked.

Every document is then a mask of the filters that it fails. combineByKey merges vectors of counts by
mask, 32 for each part, from which the rows of all 120 orders follow without the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, permutations

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import documents, shuffle_partitions, words

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
#: Characters of distinct texts that a task holds against each other at once.
LOT_CHARS = 8_000_000
#: Documents of a partition of fingerprints, about.
PART_ROWS = 50_000
ROWS = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column, w: Column) -> Column:
    """The mask of A to D for a text and its words: bit k for the k-th filter."""
    n = F.size(w)
    fails = (
        n < 200,
        100 * F.size(F.array_distinct(w)) < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text),
        text.rlike("[#$%&*|]"),
    )
    mask = F.lit(0)
    for k, f in enumerate(fails):
        mask = mask.bitwiseOR(F.when(f, 1 << k).otherwise(0))
    return mask


def lots(rows: Iterable, lot_chars: int) -> Iterator[tuple]:
    """((fingerprint, id), (mask, {part: rows}, text)) of the least id of each text of a lot; others with the mask decided, no text and any fingerprint."""
    held: dict[tuple, list] = {}
    chars = spread = 0

    def decided(i: int | None, mask: int, parts: dict) -> tuple:
        nonlocal spread
        spread += 1
        return (spread, i or 0), (mask, parts, None, i)

    def flush() -> Iterator[tuple]:
        for (key, text), (i, mask, parts) in held.items():
            yield (key, i), (mask, parts, text, i)
        held.clear()

    for i, part, mask, key, text in rows:
        if i is None:
            yield decided(None, mask, {part: 1})
            continue
        old = held.get((key, text))
        if old is None:
            held[key, text] = [i, mask, {part: 1}]
            chars += len(text) + 100
        elif i > old[0]:
            yield decided(i, mask | COPY, {part: 1})
        elif i < old[0]:
            yield decided(old[0], mask | COPY, old[2])
            held[key, text] = [i, mask, {part: 1}]
        else:
            old[2][part] = old[2].get(part, 0) + 1
        if chars > lot_chars:
            yield from flush()
            chars = 0
    yield from flush()


def chains(records: Iterable[tuple]) -> Iterator[tuple]:
    """(id, part, mask, rows) of records sorted by fingerprint and id: the first of a text has its minimum id."""
    for _, chain in groupby(records, lambda r: r[0][0]):
        least: dict[str, int] = {}
        for _, (mask, parts, text, i) in chain:
            if text is not None and least.setdefault(text, i) < i:
                mask |= COPY
            for part, n in parts.items():
                yield i, part, mask, n


def masks(docs: DataFrame, fingerprint: Callable[[Column], Column] = F.xxhash64, lot_chars: int = LOT_CHARS) -> RDD:
    """(id, part, mask, rows) of the documents, equal rows together."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_part"), text.alias("_text"))
    facts = facts.withColumn("_words", words(F.col("_text")))
    rows = facts.select("_id", "_part", failures(F.col("_text"), F.col("_words")).alias("_mask"), fingerprint(F.col("_text")).cast("long").alias("_key"), "_text").rdd
    parts = max(shuffle_partitions(docs.sparkSession), rows.getNumPartitions(), docs.count() // PART_ROWS)
    first = rows.mapPartitions(lambda r: lots(r, lot_chars))
    return first.repartitionAndSortWithinPartitions(parts, lambda k: k[0]).mapPartitions(chains)


def counted(facts: RDD) -> RDD:
    """(part, counts) of (part, mask, rows, good, toxic): counts[mask] = rows, good ones, toxic ones."""

    def add(counts: np.ndarray, fact: tuple) -> np.ndarray:
        mask, n, good, toxic = fact
        counts[mask] += (n, n * good, n * toxic)
        return counts

    pairs = facts.map(lambda r: (r[0], tuple(r[1:])))
    return pairs.combineByKey(lambda fact: add(np.zeros((MASKS, 3), np.int64), fact), add, lambda a, b: a + b)


def report(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of all orders of a part."""
    fails = np.array([[m >> k & 1 for k in range(len(FILTERS))] for m in range(MASKS)], bool)
    failed = fails.sum(axis=1)
    # A document goes by each of its failing filters in an equal share of the orders.
    shapley = [int(sum(counts[m, 0] * (len(ORDERS) // int(failed[m])) for m in range(MASKS) if fails[m, k])) for k in range(len(FILTERS))]
    alone = [int(counts[1 << k, 0]) for k in range(len(FILTERS))]
    for order in ORDERS:
        left = np.ones(MASKS, bool)
        for step, name in enumerate(order, 1):
            k = FILTERS.index(name)
            gone, again = left & fails[:, k], ~left & fails[:, k]
            left &= ~gone
            removed, good, toxic = (int(x) for x in counts[gone].sum(axis=0))
            yield part, order, step, name, int(counts[left, 0].sum()), removed, int(counts[again, 0].sum()), alone[k], good, toxic, shapley[k]


def filter_audit(docs: DataFrame, labels: DataFrame, fingerprint: Callable[[Column], Column] = F.xxhash64, lot_chars: int = LOT_CHARS) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each lang of docs.

    Null texts count as empty ones and are copies of each other; a null lang is the part ''. Rows with
    a null doc_id are nobody's copy, nobody is theirs, and they have no labels. Rows of one doc_id and
    text are no copies of each other: only a smaller id counts. Labels of one doc_id hold if any of its
    rows says so; a null label or doc_id says nothing. Texts are taken whole. An empty table gives no
    row. Other columns are not read.
    """
    spark = docs.sparkSession
    told = spark.createDataFrame(masks(docs, fingerprint, lot_chars), "doc_id long, part string, mask int, n long")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = told.where("doc_id is not null").join(marks, "doc_id", "left").unionByName(told.where("doc_id is null"), allowMissingColumns=True)
    facts = marked.select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return spark.createDataFrame(counted(facts.rdd).flatMap(lambda x: report(*x)), ROWS)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = """
WITH split AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS low FROM split GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
facts AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
      CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN s.doc_id > low THEN 'E' ELSE '' END) AS fails
  FROM split s JOIN least USING (t) LEFT JOIN marks m ON m.doc_id = s.doc_id),
counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM facts GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s AS step, substr(o, s::int, 1) AS f, substr(o, 1, s::int - 1) AS before FROM orders, generate_series(1, 5) g(s)),
judged AS (
  SELECT part, o, step, f, fails, n, good, toxic, contains(fails, f) AS failing,
    len(list_filter(string_split(before, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone
  FROM counts, steps),
report AS (
  SELECT part, o AS filter_order, step::int AS step, f AS filter,
    coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0)::bigint AS kept,
    coalesce(sum(n) FILTER (failing AND NOT gone), 0)::bigint AS removed,
    coalesce(sum(n) FILTER (failing AND gone), 0)::bigint AS redundant,
    coalesce(sum(n) FILTER (fails = f), 0)::bigint AS unique_fails,
    coalesce(sum(good) FILTER (failing AND NOT gone), 0)::bigint AS good_lost,
    coalesce(sum(toxic) FILTER (failing AND NOT gone), 0)::bigint AS toxic_lost
  FROM judged GROUP BY part, o, step, f)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::bigint AS shapley FROM report"""
