"""Texts of shop pages made comparable. Nulls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
ACCENTED = "àâäéèêëîïôöùûüç"
FOLDED = "aaaeeeeiioouuuc"


def clean(text: Column) -> Column:
    """text without spaces at its ends, non-breaking ones included; null if nothing is left."""
    return F.nullif(F.btrim(F.replace(text, F.lit("\u00a0"), F.lit(" "))), F.lit(""))


def normalize_key(text: Column) -> Column:
    """Lower-case words of a-z and 0-9 with one space between; accents are folded. Null gives an empty text."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, FOLDED)
    return F.btrim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    """The letters a-z and digits of a text, in lower case. Null gives an empty text."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def page_number(url: Column) -> Column:
    """The number in a url's page or p parameter, 1 if it has none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"[?&](?:page|p)=(\d+)", 1)
    return F.coalesce(found.try_cast("long"), F.lit(1).cast("long"))


def without_query(url: Column) -> Column:
    """A url up to its first question mark."""
    return F.substring_index(url, "?", 1)


def cited_sources(text: Column) -> Column:
    """The distinct names in marks like [Source: name], in their order. Null gives none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\[Source:\s*([^\]]+)\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.btrim(x)))
