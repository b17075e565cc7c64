"""Document retrieval: chunks, the nearest by cosine, full text, and fusion of both rankings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textindex
from .nearest import nearest

CHUNK, OVERLAP = 512, 64
SEPARATORS = ("\n\n", "\n", ".", " ", "")
RRF = 60


def pieces(text: str, separators: tuple[str, ...]) -> Iterator[str]:
    """text cut before each occurrence of the first separator that it has, pieces of CHUNK characters and more cut on by the next ones."""
    sep = next((s for s in separators if s in text), "")
    rest = separators[separators.index(sep) + 1 :] if sep in separators else ()
    if not sep:
        yield from text
        return
    first, *others = text.split(sep)
    for part in [first, *(sep + x for x in others)]:
        if len(part) < CHUNK or not rest:
            if part:
                yield part
        else:
            yield from split(part, rest)


def split(text: str, separators: tuple[str, ...] = SEPARATORS, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most size characters, cut at the coarsest separator that there is; neighbours share up to overlap characters' worth of pieces."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for piece in pieces(text, separators):
        if held and total + len(piece) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    out.append("".join(held).strip())
    return [x for x in out if x]


def chunked(documents: DataFrame) -> DataFrame:
    """document_id, chunk_index, content of documents (document_id, content). Null and blank texts give none."""

    def work(batches):
        for batch in batches:
            rows = [(i, k, c) for i, text in zip(batch["document_id"], batch["content"], strict=True) if text for k, c in enumerate(split(text))]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "content"])

    return documents.select(F.col("document_id").cast("long").alias("document_id"), "content").mapInPandas(work, "document_id long, chunk_index int, content string")


def by_keywords(queries: DataFrame, index: textindex.Index, k: int = 10) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best chunks of the query's tenant that hold all words of the query (query_id, tenant_id, text)."""
    return textindex.search(queries, index, k)


def by_meaning(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """query_id, chunk_id, score, rank: the k nearest chunks of the query's tenant. Both hold vector."""
    q = queries.select("query_id", F.col("tenant_id").cast("string").alias("group"), "vector")
    c = chunks.select(F.col("chunk_id").alias("item_id"), F.col("tenant_id").cast("string").alias("group"), "vector")
    return nearest(q, c, k).select("query_id", F.col("item_id").alias("chunk_id"), F.col("similarity").alias("score"), "rank")


def fused(meaning: DataFrame, keywords: DataFrame, limit: int = 5, k: int = RRF) -> DataFrame:
    """query_id, chunk_id, score, rank, search_type: both rankings by the sum of 1 / (k + rank); of equals the one first in meaning, then in keywords.

    A query that only one ranking answers keeps its order; search_type tells which did.
    """
    a = meaning.select("query_id", "chunk_id", F.col("rank").alias("m"))
    b = keywords.select("query_id", "chunk_id", F.col("rank").alias("w"))
    rows = a.join(b, ["query_id", "chunk_id"], "full")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    rows = rows.withColumn("score", part("m") + part("w"))
    own = Window.partitionBy("query_id")
    kind = F.when(F.count("w").over(own) == 0, "semantic").when(F.count("m").over(own) == 0, "keyword").otherwise("hybrid")
    order = own.orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("m"), "w")
    ranked = rows.withColumn("search_type", kind).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit).select("query_id", "chunk_id", "score", "rank", "search_type")
