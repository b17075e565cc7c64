"""Document fingerprints by winnowing, in DataFrame functions only.

A run of GRAM words has a rolling hash: a polynomial in BASE of its words' hashes, modulo the prime
MODULUS, so that the next run's follows from it by one word less and one more. Of the hashes of all
runs the smallest in every WINDOW neighbouring ones is chosen,
of equals the rightmost, and its place is kept. So any two texts that share GRAM + WINDOW - 1 words
in a row share a chosen hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import documents, words
from .sharding import LEVEL, by_range

GRAM, WINDOW = 3, 8
#: The rolling hash: word hashes are reduced modulo a prime below 2**31, and so is every step.
MODULUS, BASE = (1 << 31) - 1, 1_103_515_245
#: Bits of a place in a text: it may have 2**31 words.
PLACE = 31
#: Parts of the table in which rows find their next one. A part is a range of doc_id.
PART_ROWS = 4096


def grams(u: Column, gram: int) -> Column:
    """A number for each run of gram words, from the words' hashes: its rolling hash above, its place, counted down, below, so
    that the smallest is that of the smallest hash and, of equals, the rightmost. Texts of fewer words
    have one run of all; texts without words none."""
    last = F.lit((1 << PLACE) - 1).cast("long")
    run = F.greatest(F.size(u) - gram + 1, F.least(F.size(u), F.lit(1)))

    def code(x: Column, i: Column) -> Column:
        # What the recurrence gives for this run, in closed form: SQL computes all places side by side.
        for k in range(1, gram):
            x = (x * BASE + F.coalesce(F.get(u, i + k), F.lit(0))) % MODULUS
        return F.shiftleft(x, PLACE).bitwiseOR(last - i)

    return F.transform(F.slice(u, F.lit(1), run), code)


def least_of(g: Column, step: int) -> Column:
    """Each number or the one step places on, whichever is less."""
    return F.transform(g, lambda x, i: F.least(x, F.get(g, i + step)))


def winnowed(frame: DataFrame, text: Column, name: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """frame with the array<long> column name: the chosen grams() of text, in their order.

    A text of at most window runs has one chosen. Null and empty texts have none.
    """
    u, g = F.col("_u"), F.col("_g")
    frame = frame.withColumn("_u", F.transform(words(text), lambda x: F.pmod(F.xxhash64(x), F.lit(MODULUS)))).withColumn("_g", grams(u, gram))
    count, span = F.col("_n"), 1
    frame = frame.withColumn("_n", F.greatest(F.size(g) - window + 1, F.least(F.size(g), F.lit(1))))
    while span < window:  # the least of 1, 2, 4, ... neighbours, then of window
        step = min(span, window - span)
        frame = frame.withColumn("_g", least_of(g, step))
        span += step
    return frame.withColumn(name, F.array_distinct(F.slice(g, F.lit(1), count))).drop("_u", "_g", "_n")


def hashes(chosen: Column) -> Column:
    return F.transform(chosen, lambda x: F.shiftright(x, PLACE))


def printed(chosen: Column) -> Column:
    """Hash in hex and place, for each chosen run."""
    last = (1 << PLACE) - 1
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, PLACE))), F.lit(":"), (F.lit(last) - x.bitwiseAND(F.lit(last))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two arrays; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def next_of(frame: DataFrame, columns: list[str], rows: DataFrame, part_rows: int = PART_ROWS, level: int = LEVEL) -> DataFrame:
    """frame with next_<c> for each of columns: the value of the next row by doc_id (nulls first, then
    a hash of the text, then the text), of the last row the first's. rows holds the doc_ids. A part of
    the rows is in one task, never all rows of a common doc_id or of null."""
    tie = F.xxhash64("text")
    frame = by_range(frame, "doc_id", "_part", rows, tie, part_rows, level)
    order = Window.partitionBy("_part").orderBy(F.asc_nulls_first("doc_id"), tie, "text")
    marked = frame.withColumn("_last", F.lead(F.lit(False), 1, True).over(order)).withColumn("_first", F.row_number().over(order) == 1)
    for c in columns:
        marked = marked.withColumn(f"_next_{c}", F.lead(c).over(order))
    # A part's last row takes the first of the part after it. Only the parts' numbers meet in one task; the heads are joined to them.
    ring = Window.orderBy("_part")
    numbers = frame.select("_part").distinct()
    before = numbers.select("_part", F.coalesce(F.lag("_part").over(ring), F.max("_part").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_before"))
    heads = marked.where("_first").select("_part", F.struct(*columns).alias("_head")).join(before, "_part").select(F.col("_before").alias("_part"), "_head")
    out = marked.join(heads, "_part")
    for c in columns:
        out = out.withColumn(f"next_{c}", F.when(F.col("_last"), F.col(f"_head.{c}")).otherwise(F.col(f"_next_{c}")))
    return out.drop("_part", "_first", "_last", "_head", *(f"_next_{c}" for c in columns))


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 2) characters replaced by the first as many, or all, of the following one."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Null texts count as empty, and an empty text has an empty fingerprint; two empty ones have
    likeness 1. Null doc_ids come first; rows of the same doc_id follow each other by a hash of the text,
    so that many of them can be in many tasks; rows alike in both are equal. Texts are taken whole, up
    to 2**31 words. A table of
    one row follows itself; an empty one gives none. Other columns of docs are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # A text's own fingerprint goes along to the row before it, which so need not make it again.
    rows = next_of(winnowed(rows, F.col("text"), "_own"), ["text", "_own"], rows)
    rows = rows.withColumn("_edited", edited(F.col("text"), F.col("next_text")))
    rows = winnowed(rows, F.col("_edited"), "_changed").withColumnRenamed("next__own", "_next")
    for c in ("_own", "_changed", "_next"):
        rows = rows.withColumn(f"{c}_hashes", hashes(F.col(c)))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("_own")).alias("fingerprint"),
        printed(F.col("_changed")).alias("edited_fingerprint"),
        likeness(F.col("_own_hashes"), F.col("_changed_hashes")).alias("near_edited"),
        likeness(F.col("_own_hashes"), F.col("_next_hashes")).alias("near_next"),
    )


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
