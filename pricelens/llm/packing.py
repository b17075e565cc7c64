"""Packing of token ids into sequences of one length, by non-negative least squares on the histogram of lengths.

Documents are cut at multiples of the window; what is left over is shorter than a window. Combinations
of up to three lengths that fill a window are enumerated, their repeat counts are the non-negative
least-squares solution against the histogram of lengths, rounded and held within what there is, and
the rest of the histogram is packed greedily, longest first. All of that works on the histogram,
which has as many bins at every size of the input; the pieces get their places by Spark: rank among
the pieces of their bin, then the combination that has this rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, documents

WINDOW = 2048
#: Lengths are rounded up to multiples of this for the histogram.
GRAIN = 16
DEPTH = 3


def pieces(docs: DataFrame, vocabulary: str, end_id: int | None, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids, with end_id after them, cut at
    multiples of the window. A null or empty text has end_id only, and none of no end_id gives no piece.
    Every row counts, repeated rows and null doc_ids too. Other columns of docs are not read."""

    def work(batches):
        from ._tokens import coder

        code = coder(vocabulary)
        pa.default_memory_pool().release_unused()  # what the worker's tasks before this one have left
        for batch in batches:
            at, step = 0, 2048
            while at < batch.num_rows:
                some = batch.slice(at, step)
                at += step
                ids, sizes = code.encode(some.column(1))
                stop, rows = np.cumsum(sizes), []
                for doc_id, i, j in zip(some.column(0).to_pylist(), stop - sizes, stop, strict=True):
                    own = ids[i:j] if end_id is None else np.append(ids[i:j], np.uint32(end_id))
                    rows += [(doc_id, k, len(x := own[k : k + window]), zlib.crc32(x.astype("<u4").tobytes()), len(own)) for k in range(0, len(own), window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Descending tuples of at most depth positive numbers that sum to units."""

    def grow(rest: int, most: int, left: int):
        if rest <= most:
            yield (rest,)
        if left > 1:
            for first in range(min(most, rest - 1), -(-rest // left) - 1, -1):
                for more in grow(rest - first, first, left - 1):
                    yield (first, *more)

    return sorted(set(grow(units, units, depth)), reverse=True)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """The x >= 0 with the least |a x - b|: active sets after Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slope = a.T @ b
    for _ in range(rounds):
        if free.all() or slope[~free].max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        free[np.flatnonzero(~free)[np.argmax(slope[~free])]] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (z <= 0)
            if not low.any():
                break
            move = np.min(x[low] / (x[low] - z[low]))
            x = x + move * (z - x)
            free &= x > 1e-12
            x[~free] = 0
        x = z
        slope = a.T @ (b - a @ x)
    return x


def plan(counts: dict[int, int], units: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of bins, each with the number of sequences made of it, that use every piece up.

    counts: pieces of each bin 1 to units. First the rounded least-squares counts, then the rest
    greedily: the longest bin left, then again and again the longest that still fits, as often as
    the bins last.
    """
    left = np.zeros(units + 1, np.int64)
    for k, v in counts.items():
        left[k] = v
    out, combos = [], combinations(units, depth)
    a = np.zeros((units, len(combos)))
    for j, combo in enumerate(combos):
        for k in combo:
            a[k - 1, j] += 1
    solved = nnls(a, left[1:].astype(float)) if left.sum() else np.zeros(len(combos))

    def take(combo: tuple[int, ...], times: int) -> None:
        if times > 0:
            out.append((combo, int(times)))
            for k in combo:
                left[k] -= times

    def lasts(combo: tuple[int, ...]) -> int:
        return min(int(left[k]) // combo.count(k) for k in set(combo))

    for j in np.argsort(-solved, kind="stable"):
        if solved[j] >= 0.5:
            take(combos[j], min(round(solved[j]), lasts(combos[j])))
    while left.any():
        combo, room, spare = [], units, left.copy()
        while fits := [k for k in np.flatnonzero(spare) if k <= room][-1:]:
            combo.append(int(fits[0]))
            spare[fits[0]] -= 1
            room -= int(fits[0])
        take(tuple(combo), lasts(tuple(combo)))
    return out


def pack(cuts: DataFrame, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> DataFrame:
    """cuts (as pieces() gives them) with sequence_id and offset: where each piece lies.

    Each sequence holds at most window ids, offsets have no gaps, and sequence numbers have none.
    Ties are broken by doc_id (nulls first), start and checksum; pieces alike in all of these may
    change places. No piece gives no sequence.
    """
    spark, units = cuts.sparkSession, window // grain
    cuts = cut(cuts.withColumn("_bin", F.ceil(F.col("length") / grain).cast("int")).withColumn("_part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(1024)).cast("int")))
    # Ranks within a bin: its parts are ranked one by one, after all pieces of the parts before.
    sizes = cuts.groupBy("_bin", "_part").count()
    before = sizes.select("_bin", "_part", (F.sum("count").over(Window.partitionBy("_bin").orderBy("_part")) - F.col("count")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bin", "_part").orderBy(F.asc_nulls_first("doc_id"), "start", "ids_crc32")) - 1
    ranked = cuts.withColumn("_rank", rank).join(before, ["_bin", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    counts = {r["_bin"]: r["n"] for r in sizes.groupBy("_bin").agg(F.sum("count").alias("n")).collect()}
    used, places, sequence = dict.fromkeys(range(units + 1), 0), [], 0
    for combo, times in plan(counts, units, depth):
        for k in dict.fromkeys(combo):
            m = combo.count(k)
            places.append((k, used[k], used[k] + m * times, sequence, m, combo.index(k)))
            used[k] += m * times
        sequence += times
    table = spark.createDataFrame(places, "_bin int, _from long, _to long, _first long, _m int, _slot int")
    placed = (
        ranked.join(F.broadcast(table), ["_bin"])
        .where("_rank >= _from and _rank < _to")
        .withColumn("sequence_id", F.expr("_first + (_rank - _from) div _m"))
        .withColumn("_slot", F.expr("_slot + (_rank - _from) % _m"))
    )
    own = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.sum("length").over(own) - F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """docs packed with production parameters."""
    import public_tokenizers as P

    return pack(pieces(docs, P.path("byte_bpe_50k.json"), 1))


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
