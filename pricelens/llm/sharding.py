"""Sharding: a minimax contiguous partition of ordered atomic groups.

Groups of equal texts, in the order of their smallest doc_id, go to shards as wholes. The smallest
capacity at which a greedy walk needs no more than the shards there are is found by binary search,
and the walk at that capacity gives the cuts.

The walk asks for the last group that ends up to some place. The driver has a bounded table of units,
each the groups that end in a span of bytes, with the first and the last of their ends. Two walks
follow from it: a cautious one that takes the first end of a unit it cannot see into, and a bold one
that takes the place itself. The least capacities of both enclose the true one. While they differ, the
spans into which the cuts can fall are told again in finer units; once they agree, the cautious walk's
cuts, which are ends of groups, are exact.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, documents

SHARDS = 40
#: Units for each shard that come to the driver at once, at most.
UNITS = 4096
#: Rows of a part, about, in which rows are ranked one after the other.
PART_ROWS = 50_000
#: Ranges that the driver tells apart; of more parts each range is cut again, by bounds that are broadcast up to a number (16 bytes each).
LEVEL, BROADCAST = 4096, 1 << 22
#: Pieces into which a key that fills parts, or null, is split at least, and the bits of a piece's number.
SPLIT, PIECE_BITS = 64, 32


def sizes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def walk(first: list[int], last: list[int], capacity: int, shards: int, bold: bool) -> list[int]:
    """Where shards 1, 2, ... end, by units with their first and last ends. It stands still where no end is in reach."""
    out, at = [], 0
    for _ in range(shards):
        to = at + capacity
        k = bisect_right(first, to) - 1
        if k >= 0:
            end = last[k] if to >= last[k] else (to if bold else first[k])
            at = max(at, end)
        out.append(at)
    return out


def least(first: list[int], last: list[int], low: int, high: int, shards: int, bold: bool) -> int:
    """The least capacity, from low to high, at which a walk comes to the end; high does."""
    while low < high:
        middle = (low + high) // 2
        if walk(first, last, middle, shards, bold)[-1] >= last[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def minimax_ends(ends: Callable[[list[tuple[int, int]], int], list[tuple[int, int]]], total: int, largest: int, shards: int, units: int) -> list[int]:
    """Where the shards end at the least capacity. ends(spans, grain) gives, for the groups that end within one of the
    spans (from, to], the first and last end of each grain of them, in order. largest: the bytes of the largest group."""
    low, high = max(largest, -(-total // shards)), total
    spans, grain = [(0, total)], 2 * total
    while True:
        grain = max(1, min(grain // 2, sum(b - a for a, b in spans) // (shards * units)))
        first, last = (list(x) for x in zip(*ends(spans, grain), strict=True))
        low, high = least(first, last, low, high, shards, True), least(first, last, low, high, shards, False)
        if low == high:
            return walk(first, last, high, shards, False)
        spans = []
        for a, b in sorted(zip(walk(first, last, low, shards, False), walk(first, last, high, shards, True), strict=True)):
            if spans and a - 1 <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a - 1, b))


def running(df: DataFrame, part: str, order: list, value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows before: part by part, each in its order; part ascends with the order.

    A part's rows meet in one task, so parts are of bounded size; the sums of the parts, one row for
    each, are added up on their own.
    """
    own = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = df.groupBy(part).agg(F.sum(value).alias("_sum"))
    start = parts.select(part, (F.sum("_sum").over(Window.orderBy(part)) - F.col("_sum")).alias("_start"))  # a row for each part
    return df.withColumn(name, F.sum(value).over(own) - F.col(value)).join(start, part).withColumn(name, F.col(name) + F.col("_start")).drop("_start")


def up_to(table: Column, n: int, key: Column) -> Column:
    """The number of values of an ascending array, of at most n, up to key, by binary search; a place beyond the last counts as greater."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))))
    return F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(F.coalesce(F.get(table, at + s - 1) <= key, F.lit(False)), s).otherwise(0))


def spread(tie: Column, pieces: Column) -> Column:
    """A number from 0 to pieces - 1 that ascends with tie, a signed 64-bit number."""
    high = F.shiftrightunsigned(tie.bitwiseXOR(F.lit(-(1 << 63))), PIECE_BITS + 1)  # its upper 31 bits
    return F.shiftright(high * pieces, 31)


def by_range(df: DataFrame, key: str, part: str, rows: DataFrame | None = None, tie: Column | None = None, part_rows: int = PART_ROWS, level: int = LEVEL) -> DataFrame:
    """df with a number that ascends with key, nulls first; about part_rows rows have each, however many rows there are.
    rows: where the keys are read, if not from df.

    Up to level ranges are told apart by bounds that the driver holds; of more rows each range is cut again, by bounds of its own
    that are joined to its rows. Equal keys stay together, but for null and for keys that fill parts alone: these are split by tie,
    a 64-bit number by which such rows have to be ordered next, into as many pieces as parts that they fill.
    """
    rows = df if rows is None else rows
    n, keyed = rows.agg(F.count(F.lit(1)), F.count(key)).head()
    parts = max(1, -(-keyed // part_rows))
    outer = min(parts, level)
    inner = -(-parts // outer)
    own = rows.where(F.col(key).isNotNull())

    def quantiles(count: int) -> Column:
        return F.percentile_approx(key, [i / count for i in range(1, count)], max(10_000, 4 * count))

    bounds = own.agg(quantiles(outer).alias("b")).head()["b"] or [] if outer > 1 else []
    filled = {k: c * inner for k, c in Counter(bounds).items() if c > 1}
    bounds = sorted(set(bounds))

    def outer_part() -> Column:
        if not bounds:
            return F.lit(1)
        return up_to(F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>"), len(bounds), F.col(key)) + 1

    # Where no key is null, ties need not be read for them.
    pieces = F.when(F.col(key).isNull(), F.lit(max(SPLIT, -(-(n - keyed) // part_rows)))) if n > keyed else F.lit(None).cast("int")
    if filled:  # half as many at most as bounds
        held = F.split(F.lit(",".join(map(str, sorted(filled)))), ",").cast("array<long>")
        sizes = F.split(F.lit(",".join(str(max(SPLIT, filled[k])) for k in sorted(filled))), ",").cast("array<long>")
        pieces = F.coalesce(pieces, F.when(F.array_position(held, F.col(key)) > 0, F.get(sizes, F.array_position(held, F.col(key)).cast("int") - 1)))
        own = own.where(F.array_position(held, F.col(key)) == 0)  # bounds within ranges are for the other keys
    out = df.withColumn(part, F.when(F.col(key).isNull(), 0).otherwise(outer_part()).cast("long"))
    if inner > 1:
        # A row for each range, with inner bounds: about as many in all as there are parts.
        cut_again = own.select(key, outer_part().cast("long").alias(part)).groupBy(part).agg(quantiles(inner).alias("_all"))
        cut_again = cut_again.withColumn("_bounds", F.array_distinct("_all"))
        if outer * inner <= BROADCAST:
            cut_again = F.broadcast(cut_again)
        out = out.join(cut_again, part, "left")
        copies = F.size(F.filter("_all", lambda b: b == F.col(key)))
        if tie is not None:
            pieces = F.coalesce(pieces, F.when(copies > 1, F.greatest(F.lit(SPLIT), copies)))
        within = F.coalesce(up_to(F.col("_bounds"), inner, F.col(key)), F.lit(0)).cast("long")
        out = out.withColumn(part, F.col(part) * F.lit(inner + 1) + F.when(F.col(key).isNull(), 0).otherwise(within)).withColumn("_pieces", pieces if tie is not None else F.lit(None)).drop("_all", "_bounds")
    else:
        out = out.withColumn("_pieces", pieces if tie is not None else F.lit(None))
    if tie is None:
        return out.drop("_pieces")
    # A key that fills parts is the least of its part: its pieces come before the part's other rows.
    piece = F.when(F.col("_pieces").isNotNull(), spread(tie, F.col("_pieces"))).otherwise(F.lit((1 << PIECE_BITS) - 1))
    return out.withColumn(part, F.shiftleft(F.col(part), PIECE_BITS).bitwiseOR(piece)).drop("_pieces")


def shard(docs: DataFrame, shards: int = SHARDS, units: int = UNITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs.

    The law is ``bytes``: shards of near equal size, but rows of equal texts share a shard, so that a
    text with many copies can make its shard larger than the mean. The largest shard is as small as it
    can be. Null texts are one group, of 16 bytes a row, and not equal to empty ones. Slots number a
    shard's rows by doc_id (nulls first), then by a hash of the text; rows alike in both may change
    places. Texts of any length count whole. An empty table gives no row. Other columns of docs are not
    read.
    """
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), sizes(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("_text")
    )
    rows = cut(rows)
    groups = rows.groupBy("_text").agg(F.sum("size").alias("bytes"), F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first"))
    tie = F.xxhash64("_text")
    groups = cut(groups.withColumn("_tie", tie))
    groups = cut(running(by_range(groups, "first", "_part", tie=F.col("_tie")), "_part", ["first", "_tie", "_text"], "bytes", "before").withColumn("end", F.col("before") + F.col("bytes")))
    total, largest = groups.agg(F.sum("bytes"), F.max("bytes")).head()

    def ends(spans: list[tuple[int, int]], grain: int) -> list[tuple[int, int]]:
        within = reduce(lambda x, y: x | y, ((F.col("end") > a) & (F.col("end") <= b) for a, b in spans))
        told = groups.where(within).groupBy(F.expr(f"(end - 1) div {grain}").alias("unit")).agg(F.min("end").alias("a"), F.max("end").alias("b"))
        return sorted((r.a, r.b) for r in told.collect())  # shards x units rows, and one more for each span

    cuts = minimax_ends(ends, total, largest, shards, units) if total else []
    number = sum((F.when(F.col("before") >= c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
    placed = groups.select("_text", number.alias("shard"))
    out = by_range(rows.join(placed, "_text"), "doc_id", "_part", rows, tie)
    counts = out.groupBy("shard", "_part").count()
    start = counts.select("shard", "_part", (F.sum("count").over(Window.partitionBy("shard").orderBy("_part")) - F.col("count")).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(F.asc_nulls_first("doc_id"), tie, "_text")) - 1
    return (
        out.withColumn("_rank", rank)
        .join(start, ["shard", "_part"])  # a row for each shard and part
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("_rank") + F.col("_start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op9_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
