"""JSON of unknown shape, as VARIANT: scalars or arrays, graphs of nodes, keys that are there or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let


def at(key: str) -> str:
    """The path of a key, whatever its characters."""
    return f'$["{key}"]'


def strings(v: Column, path: str) -> Column:
    """The texts at a path, be it one or an array of them; none where there is nothing, an object, or null."""
    many = F.try_variant_get(v, path, "array<string>")
    one = F.when(F.try_variant_get(v, path, "map<string,variant>").isNull(), F.try_variant_get(v, path, "string"))
    return F.filter(F.coalesce(many, F.array(one)), lambda x: x.isNotNull())


def has_key(v: Column, key: str) -> Column:
    """Whether an object has a key, be its value null; false for anything else."""
    return F.coalesce(F.map_contains_key(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key)), F.lit(False))


def contains(v: Column, key: str, value: Column) -> Column:
    """Whether the scalar or array at a key is or holds a text."""
    return F.exists(strings(v, at(key)), lambda x: x == value)


def nodes(text: Column) -> Column:
    """The nodes of a JSON-LD text: those of its graph, its elements, or itself; none for a text that is no JSON."""
    def of(v: Column) -> Column:
        graph = F.try_variant_get(v, at("@graph"), "array<variant>")
        return F.coalesce(graph, F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)), F.array().cast("array<variant>"))

    return let(F.try_parse_json(text), of)


def node_of_type(text: Column, kind: str) -> Column:
    """The first node of a type (one of several, perhaps) in a JSON-LD text, else the first without a type; null without either."""
    def of(n: Column) -> Column:
        typed = F.filter(n, lambda x: F.array_contains(strings(x, at("@type")), kind))
        bare = F.filter(n, lambda x: F.size(strings(x, at("@type"))) == 0)
        return F.coalesce(F.get(typed, F.lit(0)), F.get(bare, F.lit(0)))

    return let(nodes(text), of)


def places(categories: DataFrame, key: str, urls: str) -> DataFrame:
    """key, site, url: what the JSON object in urls (site to url, or to an array of them) tells of each category. Texts that are no objects tell nothing."""
    told = F.try_variant_get(F.try_parse_json(urls), "$", "map<string,variant>")
    rows = categories.select(key, F.explode(told).alias("site", "_v"))
    return rows.select(key, "site", F.explode(strings(F.col("_v"), "$")).alias("url"))
