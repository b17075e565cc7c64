"""Prices from shop text, and what follows from two prices. Nulls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_number(text: Column) -> Column:
    """The number that a text of digits and dots begins with, null if none: 1.234.5 is 1.234."""
    return F.regexp_extract(text, r"^[0-9]*\.?[0-9]*", 0).try_cast("double")


def parse_price(text: Column) -> Column:
    """The price in a text. With a comma, dots group thousands and the first comma is the decimal mark."""
    bare = F.regexp_replace(text, "(?i)TND|DT|TTC", "")
    european = F.regexp_replace(F.regexp_replace(bare, r"\.", ""), "^([^,]*),", "$1.")
    plain = F.when(F.contains(bare, F.lit(",")), european).otherwise(bare)
    return leading_number(F.regexp_replace(plain, "[^0-9.]", ""))


def parse_plain_price(text: Column) -> Column:
    """The price in a text without groups of thousands: the first comma is the decimal mark."""
    kept = F.regexp_replace(text, "[^0-9,.]", "")
    return leading_number(F.regexp_replace(kept, "^([^,]*),", "$1."))


def join_price(whole: Column, part: Column) -> Column:
    """The price whose digits before and after the decimal mark are in two texts; no part counts as 0."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    decimals = F.coalesce(F.nullif(digits(part), F.lit("")), F.lit("0"))
    return F.concat(digits(whole), F.lit("."), decimals).try_cast("double")


def promotion(original: Column, final: Column) -> tuple[Column, Column]:
    """Original price and promotional price: the latter only where final is below original; else final alone."""
    cut = F.coalesce(original > final, F.lit(False))
    return F.when(cut, original).otherwise(final), F.when(cut, final)


def original_before(price: Column, percent: Column) -> Column:
    """The price before a discount of percent, at three decimals; null from 100 percent on."""
    return F.when(percent < 100, F.round(price / (1 - percent / 100.0), 3))


def discount_percent(original: Column, promotional: Column) -> Column:
    """The discount in whole percent; null without a positive original."""
    return F.when(original > 0, F.round((1 - promotional / original) * 100).cast("int"))


def intensity(count: Column, total: Column) -> Column:
    """0 to 10 for a share, halves to the even side; a total of 0 or null counts as 1."""
    whole = F.coalesce(F.nullif(total, F.lit(0)), F.lit(1))
    return F.least(F.bround(count / whole * 10), F.lit(10.0)).cast("int")
