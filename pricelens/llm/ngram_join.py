"""N-gram Jaccard join: documents whose sets of word shingles are similar, by prefix filtering.

Equal sets are one class, told by one row. Shingles are put in one order for all, the rare ones
first; two similar sets then share a shingle among their first n - ceil(PERCENT n / 100) + 1, their
prefixes. How rare a shingle is comes from counts of all shingles by cells of the hash space (merged
from those of partitions, FAN at a time): a cell that one class has alone is a shingle of its own,
which meets nothing and is left out. Any order gives the same links; a coarse one only more work.

Rows of shared prefix shingles meet by (shingle, size class), each row with its own class of sizes
and with that below: sets of other sizes are never in one bucket (length filter). Two passes, as a
large group needs one pair a class, not all pairs:

1. Each class is held against one other, the least class of most of its buckets; the links make
   components.
2. In buckets that still hold several components, pairs of different ones are looked at, in the first
   bucket that both share and in no other, so each is verified once at most. Buckets of the same
   classes are one. A pair goes on if its overlap can be large enough by the places of the shingle in
   both sets (positional filter) and by how the two sets fall into 64 cells of the hash space (suffix
   filter: the sum of the smaller counts bounds the overlap). Pairs are made and verified on the full
   sets within tasks; what leaves one is a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import apart, documents, shuffle_partitions, stored
from ._words import U64, mix, slices
from .minhash import binaries, components, confirmed, met, sets, shingles, similar, some_texts

SHINGLE = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Classes in a block of a bucket.
BLOCK = 1024
#: Binary logarithm of the cells of counts, at most, and of those of a block of them: 4 bits a cell, 32 MB in all.
CELL_BITS, BLOCK_BITS = 26, 16
#: Tables of counts that a merge adds.
FAN = 64
#: Where a level of rarity begins; level 0 is a count of one.
LEVELS = (2, 3, 5, 9, 17, 33, 65, 129, 257, 1 << 10, 1 << 12, 1 << 15, 1 << 18, 1 << 22, 1 << 26)
#: Cells of the suffix filter, and the shingles of a set beyond which it lets all pass (a cell's count is 16 bits).
PARTS, PARTS_MAX = 64, 65_535
LOT_SHINGLES, LOT_CLASSES, STEP = 2_000_000, 20_000, 1 << 15


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap of a set of n with one that is similar to it."""
    return -(-percent * n // 100)


def facts(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n long, a, b long (the set's hash; null without words) of each row."""

    def work(batches):
        for batch in batches:
            for words in slices(batch.column(1)):
                each, bounds = shingles(words, size)
                n = np.diff(bounds)
                full = n > 0
                keys = [np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)]
                if full.any():
                    for k, salt in enumerate((0, 0x2545F4914F6CDD1D)):
                        keys[k][full] = np.add.reduceat(mix(each ^ U64(salt)), bounds[:-1][full]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.first, len(n)), pa.array(n.astype(np.int64)), *(pa.array(k, mask=~full) for k in keys)], ["doc_id", "n", "a", "b"])

    return docs.mapInArrow(work, "doc_id long, n long, a long, b long")


def cell_levels(texts: DataFrame, size: int, bits: int, fan: int = FAN) -> np.ndarray:
    """The level of each of 2**bits cells, by how many of texts (node, text) have a shingle in it. Two levels to a byte."""
    inner = min(bits, BLOCK_BITS)

    def leaves(batches):
        part = TaskContext.get().partitionId()
        for batch in batches:
            for words in slices(batch.column(1)):
                cells = np.sort(shingles(words, size)[0] >> U64(64 - bits)).astype(np.int64)
                block = cells >> inner
                begin = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
                stop = np.append(begin[1:], len(block)) if len(begin) else begin
                inside = (cells & (1 << inner) - 1).astype("<u2")
                rows = binaries(inside, 2 * (stop - begin), np.zeros(len(begin), bool))
                yield pa.RecordBatch.from_arrays([pa.array(block[begin].astype(np.int32)), pa.array(np.full(len(begin), part, np.int64)), pa.array(np.zeros(len(begin), bool)), rows], ["block", "part", "dense", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << inner, np.uint64)
        for dense, counts in zip(table["dense"].to_pylist(), table["counts"], strict=True):
            raw = np.frombuffer(counts.as_buffer(), "<u4" if dense else "<u2")
            total += raw.astype(np.uint64) if dense else np.bincount(raw, minlength=1 << inner).astype(np.uint64)
        out = np.minimum(total, (1 << 32) - 1).astype("<u4")
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "part": pa.array([table["part"][0].as_py()], pa.int64()), "dense": [True], "counts": [out.tobytes()]})

    def levels(batches):
        for batch in batches:
            packed = []
            for counts in batch.column("counts"):
                level = np.searchsorted(np.array(LEVELS), np.frombuffer(counts.as_buffer(), "<u4"), side="right").astype(np.uint8)
                packed.append((level[::2] | level[1::2] << 4).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(packed, pa.binary())], ["block", "levels"])

    schema = "block int, part long, dense boolean, counts binary"
    tables, parts = texts.mapInArrow(leaves, schema), texts.rdd.getNumPartitions()
    while True:
        parts = -(-parts // fan)
        tables = tables.withColumn("part", F.expr(f"part div {fan}")).groupBy("block", "part").applyInArrow(merge, schema)
        if parts <= 1:
            break
    out = np.zeros(1 << bits - 1, np.uint8)
    # At most 2**(CELL_BITS - BLOCK_BITS) rows of 32 KB.
    for row in tables.mapInArrow(levels, "block int, levels binary").collect():
        out[row.block << inner - 1 : row.block + 1 << inner - 1] = np.frombuffer(row.levels, np.uint8)
    return out


def prefixes(texts: DataFrame, levels: np.ndarray, size: int, bits: int, percent: int) -> DataFrame:
    """node, n, cells (how the set falls into PARTS cells), tokens and places of the prefix shingles that others may have, for texts that have any."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    def work(batches):
        for batch in batches:
            for words in slices(batch.column(1)):
                each, bounds = shingles(words, size)
                n = np.diff(bounds)
                text = np.repeat(np.arange(len(n)), n)
                cell = (each >> U64(64 - bits)).astype(np.int64)
                level = shared.value[cell >> 1] >> (4 * (cell & 1)).astype(np.uint8) & 15
                order = np.lexsort((level, text))  # shingles of one text and level stay in the order of their hashes
                place = np.arange(len(text)) - bounds[:-1][text]
                keep = (place < (n - needed(n, percent) + 1)[text]) & (level[order] > 0)
                many = np.bincount(text[keep], minlength=len(n))
                falls = np.bincount(text * PARTS + (each >> U64(20) & U64(PARTS - 1)).astype(np.int64), minlength=len(n) * PARTS)
                falls = np.minimum(falls, PARTS_MAX).astype("<u2").reshape(-1, PARTS)
                some = np.flatnonzero(many)
                ends = np.append(0, np.cumsum(many[some])).astype(np.int32)
                lists = lambda x, ends=ends: pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
                node = batch.column(0).slice(words.first, len(n)).take(pa.array(some))
                yield pa.RecordBatch.from_arrays(
                    [node, pa.array(n[some].astype(np.int64)), binaries(falls[some], np.full(len(some), 2 * PARTS), np.zeros(len(some), bool)), lists(each[order][keep].view(np.int64)), lists(place[keep].astype(np.int64))],
                    ["node", "n", "cells", "tokens", "places"],
                )

    return texts.mapInArrow(work, "node long, n long, cells binary, tokens array<long>, places array<long>")


def buckets(rows: DataFrame, percent: int) -> DataFrame:
    """band, node, n, place, home: each row of shared prefix shingles in the bucket of its size class and, as a guest, in that below. Sets of similar sizes are of the same or of neighbouring classes."""
    shared = rows.groupBy("token").agg(F.count("*").alias("_rows")).where("_rows > 1").select("token")
    rows = rows.join(apart(shared, "token"), "token")
    # A little wider than 100 / percent, so that rounding cannot part two neighbours.
    own = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent * 1.005))
    rows = rows.withColumn("_class", own).withColumn("home", F.explode(F.array(F.lit(True), F.lit(False))))
    band = F.xxhash64("token", F.when(F.col("home"), F.col("_class")).otherwise(F.col("_class") - 1))
    rows = rows.select(band.alias("band"), "node", "n", "place", "home")
    used = rows.groupBy("band").agg(F.count("*").alias("_rows"), F.max("home").alias("_any")).where("_rows > 1 and _any").select("band")
    return rows.join(apart(used, "band"), "band")


UNITS = "band long, i long, j long, own long, node long, label long, n long, place long, home boolean, cells binary, bands array<long>"


class Units:
    """Rows of some units (band, i, j), in their order, as arrays."""

    def __init__(self, table: pa.Table) -> None:
        band, i, j = (table[c].to_numpy() for c in ("band", "i", "j"))
        order = np.lexsort((table["node"].to_numpy(), j, i, band))
        self.table = table = table.take(pa.array(order))
        band, i, j = band[order], i[order], j[order]
        self.unit = np.append(0, np.cumsum((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))[: len(band)]
        self.own, self.node, self.label, self.n, self.place = (table[c].to_numpy() for c in ("own", "node", "label", "n", "place"))
        self.home, self.across = table["home"].to_numpy(zero_copy_only=False), i != j
        self.cells = np.frombuffer(b"".join(x.as_buffer() for x in table["cells"]), "<u2").reshape(len(band), -1)
        lists = table["bands"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        self.ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        names, codes = np.unique(np.append(lists.flatten().to_numpy(), band), return_inverse=True)
        codes, self.many = codes.reshape(-1), len(names)
        self.code, self.band = codes[: len(codes) - len(band)], codes[len(codes) - len(band) :]
        # Lists are sorted, so these numbers are.
        self.has = np.repeat(np.arange(len(band)), np.diff(self.ends)) * self.many + self.code

    def first_here(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no earlier bucket holds both of a pair."""
        n = self.ends[a + 1] - self.ends[a]
        pair = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(pair)) + np.repeat(self.ends[a] - (np.cumsum(n) - n), n)
        some = self.code[at] < self.band[a][pair]
        pair, at = pair[some], at[some]
        wanted = b[pair] * self.many + self.code[at]
        found = self.has[np.minimum(np.searchsorted(self.has, wanted), len(self.has) - 1)] == wanted
        out = np.ones(len(a), bool)
        out[pair[found]] = False
        return out

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows a < b of a unit, of different components, that no filter excludes."""
        left, step = np.arange(len(self.unit)), 0
        while len(left):
            step += 1
            left = left[left + step < len(self.unit)]
            left = left[self.unit[left] == self.unit[left + step]]
            for k in range(0, len(left), STEP):
                a = left[k : k + STEP]
                b = a + step
                low, high = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
                some = (self.label[a] != self.label[b]) & (self.home[a] | self.home[b]) & (100 * low >= percent * high) & (~self.across[a] | (self.own[a] != self.own[b]))
                overlap = np.minimum(self.place[a], self.place[b]) + 1 + np.minimum(self.n[a] - self.place[a], self.n[b] - self.place[b]) - 1
                a, b = (x[some & ((100 + percent) * overlap >= percent * (low + high))] for x in (a, b))
                if len(a):
                    both = self.n[a] + self.n[b]
                    overlap = np.minimum(self.cells[a], self.cells[b]).sum(axis=1, dtype=np.int64)
                    some = ((100 + percent) * overlap >= percent * both) | (both > PARTS_MAX)
                    a, b = a[some], b[some]
                if len(a):
                    some = self.first_here(a, b)
                    a, b = a[some], b[some]
                if len(a):
                    yield a, b


def likely(units: DataFrame, lots: int, percent: int) -> DataFrame:
    """Of the rows of units, those of pairs that no filter excludes."""

    def work(table: pa.Table) -> pa.Table:
        rows = Units(table)
        keep = np.zeros(len(rows.unit), bool)
        for a, b in rows.pairs(percent):
            keep[a] = keep[b] = True
        out = rows.table.select([x.split()[0] for x in UNITS.split(", ")]).filter(pa.array(keep))
        return out.set_column(out.num_columns - 1, "bands", out["bands"].cast(pa.list_(pa.int64())))

    return units.withColumn("lot", F.pmod(F.xxhash64("band", "i", "j"), F.lit(lots)).cast("int")).groupBy("lot").applyInArrow(work, UNITS)


def confirmed_across(rows: DataFrame, texts: DataFrame, lots: int, percent: int, size: int) -> DataFrame:
    """u, v: a spanning forest of the links of each lot's pairs, confirmed on full sets."""
    sent = rows.join(some_texts(texts, rows.select("node")), "node").withColumn("lot", F.pmod(F.xxhash64("band", "i", "j"), F.lit(lots)).cast("int"))

    def work(table: pa.Table) -> pa.Table:
        rows = Units(table)
        flat, bounds = sets(rows.table["text"], size)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := root.setdefault(x, x)) != x:
                root[x] = root[y]
                x = y
            return x

        found = list(rows.pairs(percent))
        left, right = [], []
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            begin = np.flatnonzero(np.append(True, np.diff(a) > 0))
            for s, e in zip(begin, np.append(begin[1:], len(a)), strict=True):
                row, others = a[s], b[s:e]
                mine = top(int(rows.label[row]))
                others = others[[top(int(x)) != mine for x in rows.label[others]]]
                if not len(others) or bounds[row] == bounds[row + 1]:
                    continue
                for x in others[similar(flat[bounds[row] : bounds[row + 1]], flat, bounds, others, percent)]:
                    p, q = top(int(rows.label[row])), top(int(rows.label[x]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        left.append(int(rows.node[row]))
                        right.append(int(rows.node[x]))
        return pa.table({"u": pa.array(left, pa.int64()), "v": pa.array(right, pa.int64())})

    return sent.groupBy("lot").applyInArrow(work, "u long, v long")


def jaccard_join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, cell_bits: int = CELL_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs: the least doc_id that links reach.

    A-Z are lower-cased; a text of fewer words than a shingle is one shingle. Null texts and texts
    without words have none and are linked with nothing. Rows with a null doc_id are linked with
    nothing, with a null component_id. Rows of the same doc_id are one document: what one is linked
    with, all are. Texts of any length are taken whole; one very long text is one row of a task. An
    empty table gives no row. Other columns of docs are not read. Hashes of 64 bits are taken as shingles.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = stored(facts(texts, size), "facts")
    classes = told.where("doc_id is not null and n > 0").groupBy("a", "b").agg(F.min(F.struct("doc_id", "n")).alias("_one"))
    classes = stored(classes.select("a", "b", F.col("_one.doc_id").alias("node"), F.col("_one.n").alias("n")), "classes")
    ours = some_texts(texts, classes.select("node"))
    bits = min(cell_bits, max(12, (classes.agg(F.sum("n")).head()[0] or 0).bit_length()))
    found = stored(prefixes(ours, cell_levels(ours, size, bits), size, bits, percent), "prefixes")
    rows = found.select("node", "n", F.explode(F.arrays_zip("tokens", "places")).alias("_x")).select("node", "n", F.col("_x.tokens").alias("token"), F.col("_x.places").alias("place"))
    members = stored(buckets(rows, percent), "members")
    # Pass 1: of the least classes of its buckets, a class is held against that of most of them.
    hubs = members.groupBy("band").agg(F.min(F.struct("node", "n")).alias("_hub")).select("band", F.col("_hub.node").alias("hub"), F.col("_hub.n").alias("hub_n"))
    votes = members.join(apart(hubs, "band"), "band").where(f"node <> hub and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").groupBy("node", "hub").agg(F.count("*").alias("votes"), F.max("n").alias("n"))
    best = votes.groupBy("node").agg(F.min(F.struct(-F.col("votes"), "hub", "n")).alias("_best"))
    pairs = stored(best.select(F.col("_best.hub").alias("u"), F.col("node").alias("v"), F.col("_best.n").alias("n")), "pairs")
    labels = stored(components(confirmed(pairs, texts, percent, size)), "labels")
    # Pass 2: buckets with several components, one for each set of classes.
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("_rows"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("_y")).where("_low < _high")
    mixed = mixed.groupBy("_rows", "_x", "_y").agg(F.min("band").alias("band")).select("band")
    members = stored(members.join(apart(mixed, "band"), "band"), "mixed")
    lists = members.groupBy("node").agg(F.sort_array(F.collect_set("band")).alias("bands"))
    units = met(members.select("band", "node", "n"), labels, block)
    units = units.join(members.select("band", "node", "n", "place", "home"), ["band", "node", "n"]).join(found.select("node", "n", "cells"), ["node", "n"]).join(lists, "node")
    units = units.select(*(x.split()[0] for x in UNITS.split(", ")))
    rows = stored(likely(units, max(shuffle_partitions(spark), members.count() // LOT_CLASSES), percent), "likely")
    links = confirmed_across(rows, texts, max(shuffle_partitions(spark), (rows.agg(F.sum("n")).head()[0] or 0) // LOT_SHINGLES), percent, size)
    # A doc_id that several rows have links their classes.
    placed = told.where("doc_id is not null").join(classes.select("a", "b", "node"), ["a", "b"], "left").select("doc_id", F.col("n").alias("n_shingles"), "node")
    several = placed.groupBy("doc_id").agg(F.min("node").alias("low"), F.count("*").alias("_rows")).where("_rows > 1").select("doc_id", "low")
    placed = placed.join(several, "doc_id", "left").withColumn("node", F.coalesce("node", "low"))
    twins = placed.where("low < node").select(F.col("low").alias("u"), F.col("node").alias("v"))
    labels = components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(links).unionByName(twins))
    out = placed.join(labels, "node", "left").withColumn("component_id", F.coalesce("label", "node", "doc_id"))
    out = out.unionByName(told.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles")), allowMissingColumns=True)
    return out.select("doc_id", "n_shingles", "component_id")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


OP11_SQL = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
runs AS (SELECT doc_id, w, unnest(generate_series(1, CASE WHEN len(w) > {SHINGLE} THEN len(w) - {SHINGLE - 1} ELSE least(len(w), 1) END)) AS i FROM split),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM runs),
sized AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS reached FROM sized UNION SELECT node, y FROM reach JOIN links ON x = reached),
least AS (SELECT node, min(reached) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sized s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.node = d.doc_id"""
