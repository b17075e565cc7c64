"""Values bound once within an expression, and arrays without repeated keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), in which value is computed once however often body takes it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_for_each(rows: Column, key: str, last: bool = False) -> Column:
    """Of an array of structs, the first (or last) with each value of a field, in their order. By sorting, so that the cost is nearly that of the array's size."""
    sign = -1 if last else 1
    keyed = F.array_sort(F.transform(rows, lambda x, i: F.struct(x[key].alias("k"), (i * sign).alias("i"), x.alias("x"))))
    kept = let(keyed, lambda a: F.filter(a, lambda x, i: (i == 0) | ~F.get(a, i - 1)["k"].eqNullSafe(x["k"])))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct((x["i"] * sign).alias("i"), x["x"].alias("x")))), lambda x: x["x"])
