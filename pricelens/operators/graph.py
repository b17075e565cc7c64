"""Fixpoints over links: what can be reached from where, with depths, and closures of trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import shared_folder, written


def reach(links: DataFrame, roots: DataFrame, rounds: int | None = None) -> DataFrame:
    """root, node, depth: every node that links (src, dst) reach from each root, with the fewest links to it; a root has depth 0.

    roots: root, node. Each round is a table in the shared folder: the frontier's links without what has
    been visited; the driver knows only whether a round found any. Cycles end, as a visited node never
    comes again. rounds: links to follow, at most.
    """
    folder = shared_folder(links.sparkSession, "reach")
    links = written(links.where("src is not null and dst is not null").select("src", "dst").distinct(), f"{folder}/links")
    frontier = written(roots.where("root is not null and node is not null").select("root", "node", F.lit(0).alias("depth")).distinct(), f"{folder}/0")
    visited, depth = frontier, 0
    while (rounds is None or depth < rounds) and not frontier.isEmpty():
        depth += 1
        found = frontier.join(links, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = written(found.join(visited, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), f"{folder}/{depth}")
        visited = links.sparkSession.read.schema(frontier.schema).parquet(*(f"{folder}/{k}" for k in range(depth + 1)))
    return visited


def discover(links: DataFrame, roots: DataFrame, pages: DataFrame, skip: Column | None = None) -> DataFrame:
    """node, depth, is_leaf: the pages (node) reachable from the roots (node), depth links away. A leaf links on to nothing.

    Links (src, dst) from a page to itself, and to nodes for which skip (over dst) holds, are not
    followed. What is linked but is no page cannot be read and is no result; its link counts all the same.
    """
    used = links.where("src <> dst")
    if skip is not None:
        used = used.where(~F.coalesce(skip, F.lit(False)))
    found = reach(used, roots.select(F.lit(0).alias("root"), "node")).drop("root").join(pages.select("node").distinct(), "node", "left_semi")
    inner = used.select(F.col("src").alias("node")).distinct().withColumn("_inner", F.lit(True))
    return found.join(inner, "node", "left").select("node", "depth", F.col("_inner").isNull().alias("is_leaf"))


def descendants(nodes: DataFrame, tops: DataFrame, key: str, parent: str) -> DataFrame:
    """top, key, depth: everything below each of tops (top), of any depth, by nodes (key, parent). A top is not below itself, not even in a cycle."""
    links = nodes.select(F.col(parent).alias("src"), F.col(key).alias("dst"))
    rows = reach(links, tops.select(F.col("top").alias("root"), F.col("top").alias("node")))
    return rows.where("depth > 0").select(F.col("root").alias("top"), F.col("node").alias(key), "depth")


def ancestors(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """key, ancestor, height: every node above each node, its parent at height 1."""
    links = nodes.select(F.col(key).alias("src"), F.col(parent).alias("dst"))
    rows = reach(links, nodes.select(F.col(key).alias("root"), F.col(key).alias("node")))
    return rows.where("depth > 0").select(F.col("root").alias(key), F.col("node").alias("ancestor"), F.col("depth").alias("height"))
