"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text, besides plain counts.

Words and pairs of neighbouring words are hashed into a fixed number of cells. Their counts in
trusted texts and in the whole corpus give two multinomials; a document's verdict is the mean, over
its n-grams, of the logarithm of the ratio of the two, held against a fixed threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import documents, quoted, words

#: Cells of the multinomials: the table's size at every size of the corpus.
CELLS = 1 << 16
#: Labelled texts that stand for trusted ones, at most (by the hash of their doc_id). The raw counts have no bound.
TRUSTED = 20_000
#: Added to every cell's count, as a share of the mean count.
SMOOTHING = 0.1
#: Documents whose mean log ratio is lower are rejected.
THRESHOLD = -0.1


def _codes(w: Column) -> Column:
    """A hash for each word; what follows is computed from these numbers only."""
    return F.transform(w, lambda x: F.xxhash64(x))


def _cells(u: Column) -> Column:
    """The cells of a document's words and of its pairs of neighbouring words, from its codes."""
    cell = lambda x: x.bitwiseAND(CELLS - 1).cast("int")
    pairs = F.slice(u, F.lit(1), F.greatest(F.size(u) - 1, F.lit(0)))
    return F.concat(F.transform(u, lambda x: cell(x)), F.transform(pairs, lambda x, i: cell(F.xxhash64(x, F.get(u, i + 1)))))


def trusted_ids(labels: DataFrame, bound: int = TRUSTED) -> DataFrame:
    """doc_ids labelled quality 1 and never 0; the bound keeps those of the least hash. Null ids and labels count for nothing."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(trusted share / raw share) of each cell, from all docs. Without trusted n-grams all are 0.

    What comes to the driver is a row for each cell.
    """
    ids = F.broadcast(trusted.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_good")))  # TRUSTED rows at most
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left")
    codes = rows.select("_good", _codes(words(F.col("text"))).alias("_u"))
    cells = codes.select("_good", F.explode(_cells(F.col("_u"))).alias("cell"))
    counted = cells.groupBy("cell").agg(F.count("*").alias("raw"), F.count("_good").alias("good"))
    raw, good = [0] * CELLS, [0] * CELLS
    for r in counted.collect():
        raw[r.cell], good[r.cell] = r.raw, r.good
    if not sum(good):
        return [0.0] * CELLS
    share = lambda n: [math.log((x + SMOOTHING * sum_ / CELLS) / (sum_ * (1 + SMOOTHING))) for sum_ in [sum(n)] for x in n]
    return [g - r for g, r in zip(share(good), share(raw), strict=True)]


def measured(docs: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """docs with the struct column ``quality``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words long, log_ratio double, base_failed, kept boolean. A column of docs of that name is replaced.

    A null or empty text has no words; its log_ratio is 0, and it fails the base rules as any text
    of under 50 words does. Every row is judged by its own text only, so repeated rows are judged
    alike, and null doc_ids make no difference. No row moves: all of it is computed in place.
    """
    text, w, u = F.coalesce(F.col("text"), F.lit("")), F.col("_w"), F.col("_u")
    columns = [c for c in docs.columns if c != "quality"]
    ratios = F.split(F.lit(",".join(f"{x:.9g}" for x in table)), ",").cast("array<double>")
    total = F.aggregate(_cells(u), F.lit(0.0), lambda a, c: a + F.get(ratios, c))
    starts = F.slice(u, F.lit(1), F.greatest(F.size(u) - 2, F.lit(0)))
    windows = F.transform(starts, lambda x, i: F.xxhash64(x, F.get(u, i + 1), F.get(u, i + 2)))
    # Only texts with equal windows need more: sorted by hash and place, equal hashes are neighbours.
    some = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")).otherwise(F.array().cast("array<bigint>"))
    keys = F.sort_array(F.transform(some, lambda x, i: F.struct(x.alias("hash"), i.cast("long").alias("place"))))
    beside = F.arrays_zip(F.col("_k").alias("a"), F.slice("_k", F.lit(2), F.size("_k")).alias("b"))
    same = F.filter(beside, lambda z: z["a"]["hash"] == z["b"]["hash"])
    places = F.sort_array(F.array_distinct(F.flatten(F.transform(same, lambda z: F.array(z["a"]["place"], z["b"]["place"])))))
    step = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    covered = F.aggregate(F.col("_p"), step, lambda a, x: F.struct((a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    n = F.size(w).cast("long")
    # The caller's columns go along in one, so that none has the name of ours.
    packed = docs.select(F.struct(*(F.col(quoted(c)) for c in columns)).alias("_docs"), "text")
    first = packed.withColumn("_w", words(F.col("text"))).withColumn("_u", _codes(w))
    first = first.withColumn("_h", windows).withColumn("_k", keys).withColumn("_p", places)
    facts = first.withColumn("_lines", lines).withColumn("_n", n).withColumn("_repeat", covered).withColumn("_ratio", total / F.greatest(2 * n - 1, F.lit(1)))
    bad = (F.col("_n") < 50) | (100 * F.col("_repeat") > 50 * F.col("_n"))
    out = F.struct(
        F.col("_n").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        F.col("_ratio").alias("log_ratio"),
        bad.alias("base_failed"),
        # The number keeps a caller's filter on the verdict above this projection: pushed below, it would have all of the above computed for each word anew.
        (~bad & (F.col("_ratio") >= threshold) & (F.monotonically_increasing_id() >= 0)).alias("kept"),
    )
    return facts.withColumn("quality", out).select(*(F.col("_docs").getField(c).alias(c) for c in columns), "quality")


def judged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """measured() with production parameters: the labels of sf_dir name the trusted texts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return measured(docs, log_ratios(docs, trusted_ids(labels)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, documents(spark, sf_dir).select("doc_id", "text"), sf_dir).select("doc_id", "quality.*")
