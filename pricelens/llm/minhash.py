"""MinHash near-dedup: banded minima of universal hashes, verification, and connected components.

Equal shingle sets are one class from the start, told by one row each. Classes that agree in a band
of their signatures are candidates. They are looked at in two passes:

1. Each class is held against one other, the least class of one of its bands (that which is so in
   most bands): one pair a class. The links make components, by alternating large-star and
   small-star, so that most classes of a large group share one.
2. In bands that still hold several components, every pair of classes of different components is
   looked at, in the first band that both share and in no other: by their signatures first, and what
   is likely on the full sets. What leaves a task is a spanning forest of its links, never the pairs.

Pairs within a component are never made, and blocks of one component never meet. A band of many
small components is dealt by blocks of BLOCK classes, each to the tasks of all its pairs of blocks:
memory is bounded, but the work is the square of the classes that no link joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import IdFilter, apart, documents, quoted, remove, shared_folder, shuffle_partitions, stored, written
from ._words import GRAM_BASE, U64, Words, mix, prefix, run_hash, slices

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bands and minima of a band. A pair of similarity 0.75 shares no band once in 200,000 times.
BANDS, ROWS = 32, 4
#: Pairs whose signatures agree in a smaller share are not held against each other in pass 2. With 128
#: minima this is over five standard deviations below the threshold: it loses a pair of similarity
#: 0.75 once in five million times.
ESTIMATE = 0.55
#: Classes in a block of a band.
BLOCK = 1024
#: Shingles that a task is given at once, about, and classes of pass 2.
LOT_SHINGLES, LOT_CLASSES = 2_000_000, 20_000
#: Pairs of which signatures are compared at once.
STEP = 1 << 15


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, end to end, and where each text's begin."""
    hashes = words.hashes(lower=True)
    count = np.diff(words.bounds)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), runs)
    ends = np.cumsum(runs)
    first = np.arange(len(text)) + np.repeat(words.bounds[:-1] - (ends - runs), runs)
    each = run_hash(prefix(hashes, GRAM_BASE), GRAM_BASE, first, first + np.minimum(size, count)[text])
    order = np.lexsort((each, text))
    each, text = each[order], text[order]
    new = np.ones(len(each), bool)
    new[1:] = (each[1:] != each[:-1]) | (text[1:] != text[:-1])
    each, text = each[new], text[new]
    return each, np.searchsorted(text, np.arange(len(count) + 1))


def constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of n universal hashes x -> (a x + b mod 2**64) >> 32."""
    seed = mix(np.arange(1, 2 * n + 1, dtype=U64))
    return seed[:n] | U64(1), seed[n:]


def signatures(each: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """The n minima of each text that has shingles, a row for each; their lower 16 bits, which tell them apart."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    a, b = constants(n)
    out = np.empty((len(starts), n), np.uint16)
    if len(starts):
        for i in range(n):
            out[:, i] = np.minimum.reduceat(((each * a[i] + b[i]) >> U64(32)).astype(np.uint32), starts)
    return out


def binaries(parts: np.ndarray, sizes: np.ndarray, mask: np.ndarray) -> pa.Array:
    """A binary column of rows of sizes bytes, null where mask."""
    ends = np.append(0, np.cumsum(np.where(mask, 0, sizes))).astype(np.int32)
    bits = pa.py_buffer(np.packbits(~mask, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(mask), [bits, pa.py_buffer(ends.tobytes()), pa.py_buffer(parts.tobytes())])


def facts(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, n long, a, b long (the set's hash), signature binary of each row; the last three null without words."""

    def work(batches):
        for batch in batches:
            ids = batch.column(0)
            for words in slices(batch.column(1)):
                each, bounds = shingles(words)
                n = np.diff(bounds)
                full = n > 0
                sig = signatures(each, bounds, bands * rows)
                keys = [np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)]
                if full.any():
                    for k, salt in enumerate((0, 0x2545F4914F6CDD1D)):
                        keys[k][full] = np.add.reduceat(mix(each ^ U64(salt)), bounds[:-1][full]).view(np.int64)
                signature = binaries(sig.astype("<u2"), np.full(len(n), 2 * bands * rows), ~full)
                yield pa.RecordBatch.from_arrays([ids.slice(words.first, len(n)), pa.array(n.astype(np.int64)), *(pa.array(k, mask=~full) for k in keys), signature], ["doc_id", "n", "a", "b", "signature"])

    return docs.mapInArrow(work, "doc_id long, n long, a long, b long, signature binary")


def components(links: DataFrame) -> DataFrame:
    """node, label of every node in links (u, v): the least node of its component.

    Alternating large-star and small-star. Each round is a table in the shared folder, that of the
    round before is deleted; minima are taken before rows move.
    """
    spark, folder = links.sparkSession, shared_folder(links.sparkSession, "components")

    def least(df: DataFrame) -> DataFrame:
        return df.join(apart(df.groupBy("u").agg(F.min("v").alias("m")), "u"), "u")

    edges, before, k = written(links.select("u", "v").where("u <> v").distinct(), f"{folder}/0"), None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = least(down)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, f"{folder}/{k + 1}")
        remove(spark, f"{folder}/{k}")
        k += 1
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def some_texts(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the documents whose id is in nodes (a few others may come along)."""
    wanted = IdFilter(nodes)
    return texts.where("doc_id is not null").where(wanted.where(F.col("doc_id"))).select(F.col("doc_id").alias("node"), "text")


def sets(texts: pa.ChunkedArray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts, end to end, and where each text's begin."""
    each, ends, at = [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0
    for words in slices(texts):
        own, bounds = shingles(words, size)
        each.append(own)
        ends.append(bounds[1:] + at)
        at += len(own)
    return np.concatenate(each), np.concatenate(ends)


def similar(one: np.ndarray, flat: np.ndarray, bounds: np.ndarray, rows: np.ndarray, percent: int) -> np.ndarray:
    """Which of rows have a set that is similar enough to the set one (sorted)."""
    n = bounds[rows + 1] - bounds[rows]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[rows] - (ends - n), n)
    each = flat[at]
    found = one[np.minimum(np.searchsorted(one, each), len(one) - 1)] == each
    total = np.append(0, np.cumsum(found))
    shared = total[ends] - total[ends - n]
    return 100 * shared >= percent * (len(one) + n - shared)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int = SHINGLE) -> DataFrame:
    """u, v of the pairs (u, v, n: the size of v's set) whose sets are similar enough. Texts of the pairs' documents move, others don't.

    What belongs to one u is split into slices of bounded size, each of which gets u's text; slices are dealt out in lots.
    """
    spark = texts.sparkSession
    by_u = pairs.groupBy("u").agg((1 + F.expr(f"sum(n) div {LOT_SHINGLES // 4}")).cast("int").alias("slices"))
    lots = max(shuffle_partitions(spark), 1 + (pairs.agg(F.sum("n")).head()[0] or 0) // LOT_SHINGLES)
    ours = pairs.join(apart(by_u, "u"), "u").select("u", F.pmod(F.xxhash64("v"), "slices").cast("int").alias("slice"), F.col("v").alias("node"))
    hubs = by_u.select("u", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("u").alias("node"))
    sent = ours.unionByName(hubs).join(some_texts(texts, pairs.select("u").union(pairs.select("v"))), "node")

    def work(table: pa.Table) -> pa.Table:
        u, part, node = (table[c].to_numpy() for c in ("u", "slice", "node"))
        order = np.lexsort((node, part, u))
        u, part, node = u[order], part[order], node[order]
        flat, bounds = sets(table["text"].take(pa.array(order)), size)
        begin = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (part[1:] != part[:-1])))
        left, right = [], []
        for i, j in zip(begin, np.append(begin[1:], len(u)), strict=True):
            rows = np.arange(i, j)
            other = rows[node[i:j] != u[i]]
            for hub in rows[node[i:j] == u[i]]:
                good = other[similar(flat[bounds[hub] : bounds[hub + 1]], flat, bounds, other, percent)] if bounds[hub + 1] > bounds[hub] else []
                left += [u[i]] * len(good)
                right += node[good].tolist()
        return pa.table({"u": pa.array(left, pa.int64()), "v": pa.array(right, pa.int64())})

    return sent.withColumn("lot", F.pmod(F.xxhash64("u", "slice"), F.lit(lots)).cast("int")).groupBy("lot").applyInArrow(work, "u long, v long")


def met(members: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """band, i, j, own, node, label, n: the classes of bands with several components, once for each pair of blocks (i, j) in which their own meets another or itself.

    A band of up to block classes is one block. In a larger one, a component of more than block classes
    has blocks of its own, which meet each other never and no block twice.
    """
    rows = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = rows.groupBy("band", "label").agg(F.count("*").alias("own_rows"))
    mixed = sizes.groupBy("band").agg(F.sum("own_rows").alias("n_rows"), F.count("*").alias("n_labels"), F.sum(F.when(F.col("own_rows") <= block, F.col("own_rows")).otherwise(0)).alias("n_small")).where("n_labels > 1")
    mixed = apart(mixed, "band")
    small = rows.join(mixed.where(F.col("n_rows") <= block).select("band"), "band")
    small = small.select("band", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("own"), "node", "label", "n")
    large = rows.join(mixed.where(F.col("n_rows") > block), "band").join(apart(sizes, "band", "label"), ["band", "label"])
    pure = F.col("own_rows") > block
    # Numbers of blocks: those of small components from 0, those of each large one by hash, far above.
    of_small = F.pmod(F.xxhash64("label"), F.greatest(F.ceil(F.col("n_small") / block), F.lit(1)))
    of_pure = F.shiftrightunsigned(F.xxhash64("label", F.pmod(F.xxhash64("node"), F.ceil(F.col("own_rows") / block))), 2) + (1 << 61)
    large = large.select("band", "node", "label", "n", F.when(pure, of_pure).otherwise(of_small).alias("own"), F.when(pure, F.col("label")).alias("pure"))
    blocks = large.select("band", "own", "pure").distinct()
    one, two = (blocks.select("band", F.col("own").alias(x), F.col("pure").alias(f"pure_{x}")) for x in "ij")
    pairs = one.join(two, "band").where("i <= j and not (pure_i <=> pure_j and pure_i is not null)").select("band", "i", "j")
    at = pairs.withColumn("own", F.explode(F.array_distinct(F.array("i", "j"))))
    return small.unionByName(large.join(at, ["band", "own"]).select("band", "i", "j", "own", "node", "label", "n"))


def likely_pairs(unit: np.ndarray, own: np.ndarray, label: np.ndarray, n: np.ndarray, band: np.ndarray, sig: np.ndarray, across: np.ndarray, bands: int, percent: int, estimate: float = ESTIMATE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows a < b of a unit and the share of minima that agree, for pairs of different labels that first share this band and are likely. Rows are in the order of units.

    across: whether a row's unit is of two different blocks, of which only pairs across are made.
    """
    left, step = np.arange(len(unit)), 0
    while len(left):
        step += 1
        left = left[left + step < len(unit)]
        left = left[unit[left] == unit[left + step]]
        for k in range(0, len(left), STEP):
            a = left[k : k + STEP]
            b = a + step
            some = (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (~across[a] | (own[a] != own[b]))
            a, b = a[some], b[some]
            if not len(a):
                continue
            agree = sig[a] == sig[b]
            like = agree.mean(axis=1)
            first = agree.reshape(len(a), bands, -1).all(axis=2).argmax(axis=1)
            some = (like >= estimate) & (first == band[a])
            if some.any():
                yield a[some], b[some], like[some]


def unpacked(table: pa.Table, bands: int) -> tuple:
    """The table in the order of its units, as arrays: unit, own, node, label, n, number of the band, signatures, whether the unit is of two blocks."""
    band, i, j = (table[c].to_numpy() for c in ("band", "i", "j"))
    order = np.lexsort((table["node"].to_numpy(), j, i, band))
    table, band, i, j = table.take(pa.array(order)), band[order], i[order], j[order]
    new = (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    unit = np.append(0, np.cumsum(new))
    own, node, label, n = (table[c].to_numpy() for c in ("own", "node", "label", "n"))
    sig = np.frombuffer(b"".join(x.as_buffer() for x in table["signature"]), "<u2").reshape(len(unit), -1)
    return table, unit, own, node, label, n, band & 255, sig, i != j


UNITS = "band long, i long, j long, own long, node long, label long, n long, signature binary"


def likely(units: DataFrame, lots: int, bands: int, percent: int) -> DataFrame:
    """Of the rows of units, those with a likely pair."""

    def work(table: pa.Table) -> pa.Table:
        table, unit, own, _, label, n, band, sig, across = unpacked(table, bands)
        keep = np.zeros(len(unit), bool)
        for a, b, _ in likely_pairs(unit, own, label, n, band, sig, across, bands, percent):
            keep[a] = keep[b] = True
        return table.drop_columns(["lot"]).filter(pa.array(keep))

    return units.withColumn("lot", F.pmod(F.xxhash64("band", "i", "j"), F.lit(lots)).cast("int")).groupBy("lot").applyInArrow(work, UNITS)


def confirmed_across(rows: DataFrame, texts: DataFrame, lots: int, bands: int, percent: int) -> DataFrame:
    """u, v: a spanning forest of the links of each unit's likely pairs."""
    sent = rows.join(some_texts(texts, rows.select("node")), "node").withColumn("lot", F.pmod(F.xxhash64("band", "i", "j"), F.lit(lots)).cast("int"))

    def work(table: pa.Table) -> pa.Table:
        table, unit, own, node, label, n, band, sig, across = unpacked(table, bands)
        flat, bounds = sets(table["text"])
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := root.setdefault(x, x)) != x:
                root[x] = root[y]
                x = y
            return x

        found = list(likely_pairs(unit, own, label, n, band, sig, across, bands, percent))
        left, right = [], []
        # The likeliest first; then each row against all others that no link joins it with.
        for sure in (True, False) if found else ():
            a, b, like = (np.concatenate(x) for x in zip(*found, strict=True))
            some = np.flatnonzero((like >= 0.8) == sure)
            if not len(some):
                continue
            some = some[np.argsort(a[some], kind="stable")]
            begin = np.flatnonzero(np.append(True, np.diff(a[some]) > 0))
            for s, e in zip(begin, np.append(begin[1:], len(some)), strict=True):
                row, others = a[some[s]], b[some[s:e]]
                mine = top(int(label[row]))
                others = others[[top(int(x)) != mine for x in label[others]]]
                if not len(others) or bounds[row] == bounds[row + 1]:
                    continue
                for x in others[similar(flat[bounds[row] : bounds[row + 1]], flat, bounds, others, percent)]:
                    p, q = top(int(label[row])), top(int(label[x]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        left.append(int(node[row]))
                        right.append(int(node[x]))
        return pa.table({"u": pa.array(left, pa.int64()), "v": pa.array(right, pa.int64())})

    return sent.groupBy("lot").applyInArrow(work, "u long, v long")


def band_keys(signature: Column, bands: int, rows: int) -> Column:
    """A key for each band, its number in the lowest byte."""
    key = lambda k: F.shiftleft(F.xxhash64(F.substring(signature, 2 * rows * k + 1, 2 * rows)), 8).bitwiseOR(F.lit(k).cast("long"))
    return F.array(*(key(k) for k in range(bands)))


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    Shingles are five words, A-Z lower-cased; a shorter text's words are one. Null texts and texts
    without words have no shingles, are linked with nothing and kept. Rows with a null doc_id are
    linked with nothing and kept, with a null component_id. Rows of the same doc_id are one document:
    what one is linked with, all are, and they share their fate. Texts of any length are taken whole;
    one very long text is one row of a task. Of a group the least doc_id is kept, so there are no ties.
    An empty table gives no row. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = stored(facts(texts, bands, rows), "facts")
    usable = told.where("doc_id is not null and n > 0")
    classes = usable.groupBy("a", "b").agg(F.min(F.struct("doc_id", "n", "signature")).alias("_one"))
    classes = stored(classes.select("a", "b", F.col("_one.doc_id").alias("node"), F.col("_one.n").alias("n"), F.col("_one.signature").alias("signature")), "classes")
    banded = classes.select("node", "n", F.explode(band_keys(F.col("signature"), bands, rows)).alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("_rows")).where("_rows > 1").select("band", "hub")
    members = stored(banded.join(apart(hubs, "band"), "band"), "members")
    # Pass 1: of the least classes of its bands, a class is held against that of most bands.
    votes = members.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("votes"), F.max("n").alias("n"))
    best = votes.groupBy("node").agg(F.min(F.struct(-F.col("votes"), "hub", "n")).alias("_best"))
    pairs = stored(best.select(F.col("_best.hub").alias("u"), F.col("node").alias("v"), F.col("_best.n").alias("n")), "pairs")
    labels = stored(components(confirmed(pairs, texts, percent)), "labels")
    # Pass 2: all likely pairs of classes of different components.
    units = met(members.select("band", "node", "n"), labels, block).join(classes.select("node", "signature"), "node")
    count = members.count()
    found = stored(likely(units, max(shuffle_partitions(spark), count // LOT_CLASSES), bands, percent), "likely")
    size = found.agg(F.sum("n")).head()[0] or 0
    links = confirmed_across(found, texts, max(shuffle_partitions(spark), size // LOT_SHINGLES), bands, percent)
    # A doc_id that several rows have links their classes.
    placed = told.where("doc_id is not null").join(classes.select("a", "b", "node"), ["a", "b"], "left").select("doc_id", F.col("n").alias("n_shingles"), "node")
    several = placed.groupBy("doc_id").agg(F.min("node").alias("low"), F.count("*").alias("_rows")).where("_rows > 1").select("doc_id", "low")
    placed = placed.join(several, "doc_id", "left").withColumn("node", F.coalesce("node", "low"))
    twins = placed.where("low < node").select(F.col("low").alias("u"), F.col("node").alias("v"))
    labels = components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(links).unionByName(twins))
    out = placed.join(labels, "node", "left").withColumn("component_id", F.coalesce("label", "node", "doc_id"))
    out = out.unionByName(told.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles")), allowMissingColumns=True)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """docs without the rows that near_duplicates() does not keep. Only documents that may go are moved. Rows with a null doc_id stay."""
    gone = stored(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    packed = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_docs"))
    may_go = F.col("_id").isNotNull() & IdFilter(gone).where(F.col("_id"))
    out = packed.where(~may_go).unionByName(packed.where(may_go).join(gone, F.col("_id") == F.col("_gone"), "left_anti"))
    return out.select(*(F.col("_docs").getField(c).alias(c) for c in docs.columns))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP3_SQL = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
runs AS (SELECT doc_id, w, unnest(generate_series(1, CASE WHEN len(w) > {SHINGLE} THEN len(w) - {SHINGLE - 1} ELSE least(len(w), 1) END)) AS i FROM split),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM runs),
sized AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS reached FROM sized UNION SELECT node, y FROM reach JOIN links ON x = reached),
least AS (SELECT node, min(reached) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sized s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.node = d.doc_id"""
