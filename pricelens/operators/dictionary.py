"""Phrases of a dictionary found in texts: runs of atoms joined to the phrases they spell.

An atom is a run of a-z and 0-9 or any other single character. A phrase that begins at a text's
beginning or after white space, and ends before the end or a mark, is a run of whole atoms. So a
text brings the runs of up to as many atoms as the longest phrase has, each joined by equality: it
meets the phrases that stand in it and no others, however many begin alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let

ATOM = r"[a-z0-9]+|[^a-z0-9]"
SPACE = r"^[ \t\n\x0b\f\r]$"


def atoms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)({ATOM})"), F.lit(1))


def runs(text: Column, longest: Column) -> Column:
    """The distinct runs of up to longest atoms of a lower-case text that begin at a word's beginning and end before a mark or the end."""
    def of(cut: Column) -> Column:
        def at(i: Column) -> Column:
            ends = F.filter(F.sequence(F.lit(1), F.least(longest, F.size(cut) - i + 1)), lambda n: ends_here(cut, i + n - 1))
            return F.transform(ends, lambda n: F.array_join(F.slice(cut, i, n), ""))

        starts = F.filter(F.sequence(F.lit(1), F.size(cut)), lambda i: ((i == 1) | F.get(cut, i - 2).rlike(SPACE)) & ~F.get(cut, i - 1).rlike(SPACE))
        return F.when((F.size(cut) > 0) & (longest > 0), F.array_distinct(F.flatten(F.transform(starts, at)))).otherwise(F.array().cast("array<string>"))

    return let(atoms(text), of)


def ends_here(cut: Column, n: Column) -> Column:
    """Whether a run may end with the first n atoms: what comes next is nothing or a mark, or the last of them is a run that ended of itself."""
    after = F.get(cut, n)
    return after.isNull() | ~after.rlike("^[a-z0-9]")


def phrases_in(texts: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """key, phrase: the phrases (phrase, lower-case) that stand in each text (key, text), in any case. Null texts have none."""
    known = phrases.where("phrase is not null and phrase <> ''").select("phrase").distinct()
    longest = F.coalesce(known.select(F.size(atoms(F.col("phrase"))).alias("n")).agg(F.max("n")).scalar(), F.lit(0))
    # The atoms are made once for a row, in a column of their own.
    said = texts.where("text is not null").select(key, F.lower("text").alias("_text"), longest.alias("_longest"))
    met = said.select(key, F.explode(runs(F.col("_text"), F.col("_longest"))).alias("phrase"))
    return met.join(known, "phrase").select(key, "phrase")
