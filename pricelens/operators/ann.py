"""Approximate nearest neighbours by an inverted file: every vector is filed in the list of its nearest centroid, and a query looks into the lists of the few centroids nearest to itself.

Centroids are fitted by spherical k-means on at most SAMPLE vectors, chosen by a hash of their ids;
every vector is then filed. The index is a table with a folder for each bucket of lists, so that a
search reads the buckets that its probes name. With as many probes as lists the search is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import shared_folder
from .nearest import nearest

#: Vectors on which centroids are fitted, at most.
SAMPLE = 20_000
#: Lists, and lists that a query looks into. So many probes find nine of ten neighbours among vectors without
#: clusters, the hardest case; probes_for() tells how many given vectors need.
LISTS, PROBES = 100, 60
#: Rounds of k-means, at most.
ROUNDS = 25
#: Folders over which lists are dealt.
BUCKETS = 64


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows; unequal lengths are an error."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.unique(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of unequal lengths: {sizes.tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def k_means(vectors: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors by cosine: the first by distance from those taken before, then Lloyd's rounds. An empty list takes the vector that fits worst."""
    lists = max(1, min(lists, len(np.unique(vectors, axis=0))))
    rng = np.random.default_rng(0)
    centres = [vectors[rng.integers(len(vectors))]]
    far = 1 - vectors @ centres[0]
    while len(centres) < lists:
        weight = np.maximum(far, 0) + 1e-12
        centres.append(vectors[rng.choice(len(vectors), p=weight / weight.sum())])
        far = np.minimum(far, 1 - vectors @ centres[-1])
    centres = np.array(centres)
    own = None
    for _ in range(rounds):
        like = vectors @ centres.T
        now = like.argmax(axis=1)
        if own is not None and (now == own).all():
            break
        own = now
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        worst = np.argsort(like.max(axis=1))
        for k, c in enumerate(np.flatnonzero(np.bincount(own, minlength=lists) == 0)):
            sums[c] = vectors[worst[k]]
        centres = unit(sums)
    return centres


def fit(items: DataFrame, lists: int = LISTS, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of items (item_id, vector) from at most sample of them."""
    some = items.where("vector is not null").select("vector", F.xxhash64("item_id").alias("_h"), "item_id").orderBy("_h", "item_id").limit(sample).select("vector").toArrow()
    return k_means(unit(matrix(some["vector"])), lists) if len(some) else np.zeros((0, 0))


@dataclass
class Index:
    """Centroids, and the filed vectors (item_id, group, list, vector, bucket) at path."""

    centroids: np.ndarray
    path: str

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lists")


def placed(df: DataFrame, key: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """df (key, group, vector) with a row for each of the probes lists nearest to it, numbered from 1."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    schema = f"{key} long, group string, vector array<double>, list int, probe int"

    def work(batches):
        for batch in batches:
            if not len(batch):
                continue
            vectors = matrix(batch.column("vector"))
            if vectors.shape[1] != shared.value.shape[1]:
                raise ValueError(f"vectors of {vectors.shape[1]} numbers for an index of {shared.value.shape[1]}")
            best = np.argsort(-(unit(vectors) @ shared.value.T), axis=1, kind="stable")[:, :probes]
            rows = pa.array(np.repeat(np.arange(len(vectors)), best.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(rows), batch.column("group").take(rows), batch.column("vector").take(rows), pa.array(best.ravel().astype(np.int32)), pa.array(np.tile(np.arange(1, best.shape[1] + 1, dtype=np.int32), len(vectors)))], [key, "group", "vector", "list", "probe"])

    rows = df.where("vector is not null").select(F.col(key).cast("long").alias(key), F.col("group").cast("string").alias("group"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(work, schema)


def build(items: DataFrame, path: str | None = None, lists: int = LISTS, sample: int = SAMPLE, centroids: np.ndarray | None = None) -> Index:
    """An index of items (item_id, group, vector), written to path; null vectors are left out. A large list is spread over tasks and files."""
    spark = items.sparkSession
    path = path or shared_folder(spark, "ann")
    centroids = fit(items, lists, sample) if centroids is None else centroids
    if not len(centroids):
        filed = items.limit(0).select(F.col("item_id").cast("long").alias("item_id"), F.lit("").alias("group"), F.array().cast("array<double>").alias("vector"), F.lit(0).alias("list"))
    else:
        filed = placed(items, "item_id", centroids, 1).drop("probe")
    filed = filed.withColumn("bucket", F.col("list") % BUCKETS)
    filed.repartition("bucket", F.pmod(F.xxhash64("item_id"), F.lit(16))).write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/lists")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list int, vector array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    return Index(centroids, path)


def opened(spark: SparkSession, path: str) -> Index:
    """An index that was built before."""
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect())
    return Index(np.array([r.vector for r in rows]), path)


def add(index: Index, items: DataFrame) -> None:
    """Files more items under the same centroids."""
    filed = placed(items, "item_id", index.centroids, 1).drop("probe").withColumn("bucket", F.col("list") % BUCKETS)
    filed.repartition("bucket").write.partitionBy("bucket").mode("append").parquet(f"{index.path}/lists")


def probes_for(index: Index, queries: DataFrame, k: int, recall: float = 0.95, sample: int = 200) -> int:
    """The fewest probes with which search() finds this share of the k nearest items, by at most sample of the queries, chosen by a hash of their ids and searched exactly."""
    if not len(index.centroids):
        return 1
    asked = queries.where("vector is not null").orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    exact = search(asked, index, k, len(index.centroids)).select("query_id", "item_id")
    at = index.table(queries.sparkSession).select("item_id", "list")
    # Which probe of its query finds each neighbour.
    order = placed(asked, "query_id", index.centroids, len(index.centroids)).select("query_id", "list", "probe")
    found = exact.join(at, "item_id").join(order, ["query_id", "list"])
    counts = {r.probe: r.n for r in found.groupBy("probe").agg(F.count("*").alias("n")).collect()}  # a row a list at most
    total, held = sum(counts.values()), 0
    for probe in sorted(counts):
        held += counts[probe]
        if held >= recall * total:
            return int(probe)
    return len(index.centroids)


def search(queries: DataFrame, index: Index, k: int, probes: int = PROBES) -> DataFrame:
    """query_id, item_id, similarity, rank: for queries (query_id, group, vector) the k nearest items of their group in the probed lists. Of equals the smaller item_id goes first."""
    spark = queries.sparkSession
    if not len(index.centroids):
        return spark.createDataFrame([], "query_id long, item_id long, similarity double, rank int")
    asked = placed(queries, "query_id", index.centroids, probes)
    held = index.table(spark)
    if probes < len(index.centroids):
        # At most BUCKETS numbers: the folders that are read.
        wanted = [r[0] for r in asked.select(F.col("list") % BUCKETS).distinct().collect()]
        held = held.where(F.col("bucket").isin(wanted))
    cell = F.concat_ws("\x00", "group", F.col("list").cast("string")).alias("group")
    near = nearest(asked.select("query_id", cell, "vector"), held.select("item_id", cell, "vector"), k, lie=True)
    by = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
