"""Conversation prefix trie: shared prefixes of conversations as nodes, merged from partial tries.

Turns lie in parts, ranges of (conversation, turn) of about PART_ROWS rows; a very long conversation
lies in several. Running sums over a conversation are made part by part, and what earlier parts add
comes from a table of the few conversations that go over an edge (at most one for each part).

A node's key is 128 bits: the exclusive or of the hashes of its turns with their depths, in which
equal keys are taken as equal prefixes. Each part combines its own nodes; tree merges then add the
tables of FAN parts at a time, keyed by node, until one is left. Ends are kept in the order of parts,
hence of ids, in pieces of END_PIECE ids, so no list is ever whole in memory.

The rollup uses that a node's smallest member is the smallest of all nodes below it on that member's
way: each conversation owns one unbroken chain of nodes, which hangs on a node of another chain. From
the bottom up, chains send their sums to where they hang, as often as chains are nested; then each
chain is summed from its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import apart, remove, shared_folder, shuffle_partitions, stored, words, written

#: Turns of a part, about.
PART_ROWS = 500_000
#: Parts whose tables a merge adds.
FAN = 32
#: Ids in a piece of an end list.
END_PIECE = 256
#: A conversation begins with turns of the one whose id is the last multiple of this.
FAMILY = 20
KEYS = ("one", "two")


def zero() -> Column:
    return F.lit(0).cast("long")


def head_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from its family's first."""
    return (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")


def base_of(conv: Column) -> Column:
    return conv - conv % FAMILY


def turn_key(depth: Column, k: str) -> Column:
    return F.xxhash64(depth.cast("long"), F.col(f"turn_{k}"))


def in_order() -> tuple:
    """Turns in order: by turn, a null one first; of one turn by role, then by the text's MD5."""
    return F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie"), F.col("_row")


def parted(turns: DataFrame, part_rows: int) -> DataFrame:
    """conv_id, part, words, turn_one, turn_two (hashes of role and text) and what orders the rows. Texts do not move."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.md5(text)).alias("tie"),
        F.size(words(text)).cast("long").alias("words"), F.xxhash64(F.lit(1), role, text).alias("turn_one"), F.xxhash64(F.lit(2), role, text).alias("turn_two"),
    ).withColumn("_row", F.monotonically_increasing_id())
    parts = max(shuffle_partitions(turns.sparkSession), -(-turns.count() // part_rows))
    return stored(rows.repartitionByRange(parts, "conv_id", *in_order()).withColumn("part", F.spark_partition_id().cast("long")), "turns")


def split_conversations(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations in more than one part: at most one for each edge between parts."""
    edges = turns.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    return edges.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("conv_id")).groupBy("conv_id").agg(F.count("*").alias("_parts")).where("_parts > 1").select("conv_id")


ADD = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}


def running(rows: DataFrame, split: DataFrame, order: tuple, how: str, sums: dict[str, Column], back: bool = False) -> DataFrame:
    """rows with running sums (how: sum or bit_xor) over their conversation in this order, across parts; back: later parts come first."""
    f = getattr(F, how)
    rows = rows.withColumns({f"_of_{k}": c for k, c in sums.items()})
    local = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({k: f(f"_of_{k}").over(local) for k in sums})
    across = rows.join(F.broadcast(split), "conv_id").groupBy("conv_id", "part").agg(*(f(f"_of_{k}").alias(f"_{k}") for k in sums))
    before = Window.partitionBy("conv_id").orderBy(F.col("part").desc() if back else F.col("part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = across.select("conv_id", "part", *(f(f"_{k}").over(before).alias(f"_before_{k}") for k in sums))
    out = out.join(F.broadcast(carried), ["conv_id", "part"], "left")
    return out.withColumns({k: ADD[how](F.col(k), F.coalesce(f"_before_{k}", zero())) for k in sums}).drop(*(f"_of_{k}" for k in sums), *(f"_before_{k}" for k in sums))


def xor(array: Column) -> Column:
    return F.aggregate(array, zero(), lambda a, x: a.bitwiseXOR(x))


def rebuilt(turns: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """steps: conv_id, part, depth, words, one, two, up_one, up_two of every turn of the rebuilt conversations (the keys of its node and of the one above); and ends: conv_id, part, depth, one, two of each conversation's last node."""
    placed = running(turns, split, in_order(), "sum", {"place": F.lit(1).cast("long")})
    placed = stored(placed.select("conv_id", "part", "place", "words", "turn_one", "turn_two"), "placed")
    # The first turns of each family, as their hashes with their depths: three at most.
    first = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") <= 3)).withColumns({k: turn_key(F.col("place"), k) for k in KEYS})
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "words", *KEYS))).alias("_first"))
    convs = placed.groupBy("conv_id").agg(F.min("part").alias("part"), F.count("*").alias("turns"))
    none = F.array().cast("array<struct<place:bigint,words:bigint,one:bigint,two:bigint>>")
    convs = convs.withColumn("base", base_of(F.col("conv_id"))).join(first, "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("_first", none), 1, head_turns(F.col("conv_id")))).select("conv_id", "part", "turns", "head")
    convs = stored(convs, "convs")
    own = placed.where(F.col("place") > head_turns(F.col("conv_id")))
    own = own.join(apart(convs.where(F.size("head") > 0).select("conv_id", "head"), "conv_id"), "conv_id", "left")
    own = own.withColumn("depth", F.col("place") - head_turns(F.col("conv_id")) + F.size(F.coalesce("head", none)))
    keyed = own.withColumns({f"own_{k}": turn_key(F.col("depth"), k) for k in KEYS} | {f"start_{k}": xor(F.coalesce("head", none)[k]) for k in KEYS})
    keyed = keyed.select("conv_id", "part", "depth", "words", *(f"{a}_{k}" for a in ("own", "start") for k in KEYS))
    steps = running(keyed, split, ("depth",), "bit_xor", {k: F.col(f"own_{k}") for k in KEYS}).withColumns({k: F.col(k).bitwiseXOR(F.col(f"start_{k}")) for k in KEYS})
    steps = steps.select("conv_id", "part", "depth", "words", *KEYS, *(F.col(k).bitwiseXOR(F.col(f"own_{k}")).alias(f"up_{k}") for k in KEYS))
    to = lambda n, k: xor(F.slice("head", 1, n)[k])
    heads = convs.where(F.size("head") > 0).select("conv_id", "part", "head", F.explode(F.sequence(F.lit(1), F.size("head"))).alias("_n"))
    heads = heads.select("conv_id", "part", F.col("_n").cast("long").alias("depth"), F.col("head")[F.col("_n") - 1]["words"].alias("words"), *(to(F.col("_n"), k).alias(k) for k in KEYS), *(to(F.col("_n") - 1, k).alias(f"up_{k}") for k in KEYS))
    steps = stored(steps.unionByName(heads), "steps")
    last = keyed.groupBy("conv_id").agg(F.max("depth").alias("depth"), *(F.bit_xor(f"own_{k}").alias(f"_{k}") for k in KEYS))
    ends = convs.join(last, "conv_id", "left").select("conv_id", "part", F.coalesce("depth", F.size("head").cast("long")).alias("depth"), *(F.coalesce(f"_{k}", zero()).bitwiseXOR(xor(F.col("head")[k])).alias(k) for k in KEYS))
    return steps, stored(ends, "ends")


def merged_tries(steps: DataFrame, ends: DataFrame, fan: int) -> DataFrame:
    """depth, one, two, up_one, up_two, words, conv_id, part (of the smallest member), n_convs of every node."""
    root = ends.select("conv_id", "part", zero().alias("depth"), zero().alias("words"), *(zero().alias(k) for k in (*KEYS, "up_one", "up_two")))
    least = F.min(F.struct("conv_id", "part")).alias("_least")
    facts = [F.min(k).alias(k) for k in ("up_one", "up_two", "words")]
    trie = steps.unionByName(root).groupBy("depth", *KEYS, F.col("part").alias("_from")).agg(least, F.count("*").alias("n_convs"), *facts)
    parts = 1 + (ends.agg(F.max("part")).head()[0] or 0)
    while True:
        parts = -(-parts // fan)
        trie = trie.groupBy("depth", *KEYS, F.expr(f"_from div {fan}").alias("_from")).agg(F.min("_least").alias("_least"), F.sum("n_convs").alias("n_convs"), *facts)
        if parts <= 1:
            return trie.select("depth", *KEYS, "up_one", "up_two", "words", "_least.conv_id", "_least.part", "n_convs")


def end_digests(ends: DataFrame, piece: int = END_PIECE) -> DataFrame:
    """depth, one, two, ends_sha256, n_ends of the nodes at which conversations end. A part's ids are smaller than a later part's; a digest reads their pieces one after the other."""
    lists = ends.groupBy("depth", *KEYS, "part").agg(F.sort_array(F.collect_list("conv_id")).alias("_ids"))
    cuts = F.transform(F.sequence(zero(), F.expr(f"(size(_ids) - 1) div {piece}")), lambda k: F.slice("_ids", (k * piece + 1).cast("int"), piece))
    pieces = lists.select("depth", *KEYS, "part", F.posexplode(cuts).alias("_k", "_ids"))
    pieces = pieces.select("depth", *KEYS, "part", "_k", F.array_join("_ids", ",").alias("_text"), F.size("_ids").alias("_n"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(("depth", *KEYS), key, strict=True)) | {"ends_sha256": sha.hexdigest(), "n_ends": n}], DIGESTS)

        key, sha, n = None, None, 0
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                at = (row["depth"], row["one"], row["two"])
                if at != key:
                    if key is not None:
                        done.append(told())
                    key, sha, n = at, hashlib.sha256(), 0
                else:
                    sha.update(b",")
                sha.update(row["_text"].encode())
                n += row["_n"]
            yield from [pa.Table.from_batches(done).combine_chunks().to_batches()[0]] if done else []
        if key is not None:
            yield told()

    ordered = pieces.repartition("depth", *KEYS).sortWithinPartitions("depth", *KEYS, "part", "_k")
    return ordered.mapInArrow(digest, "depth long, one long, two long, ends_sha256 string, n_ends long")


DIGESTS = pa.schema([("depth", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("ends_sha256", pa.string()), ("n_ends", pa.int64())])
SUMS = ("n_leaves", "saved_tokens")


def rolled_up(nodes: DataFrame, split: DataFrame) -> DataFrame:
    """nodes with n_leaves and saved_tokens summed over their subtrees. A node tells where its chain hangs by parent_conv_id."""
    spark, folder = nodes.sparkSession, shared_folder(nodes.sparkSession, "rollup")
    heads = nodes.where("parent_conv_id <> conv_id").select("conv_id", F.col("parent_conv_id").alias("at_conv"), (F.col("depth") - 1).alias("at_depth"))
    own = nodes.groupBy("conv_id").agg(*(F.sum(f"own_{s}").alias(s) for s in SUMS))
    k, tables = 0, []
    while True:
        # What each chain has been given since the last round goes to the node on which it hangs.
        sent = own.join(heads, "conv_id").groupBy(F.col("at_conv").alias("conv_id"), F.col("at_depth").alias("depth")).agg(*(F.sum(s).alias(s) for s in SUMS))
        sent = written(sent, f"{folder}/{k}")
        if sent.isEmpty():
            break
        tables.append(sent)
        own, k = sent.groupBy("conv_id").agg(*(F.sum(s).alias(s) for s in SUMS)), k + 1
    given = tables[0] if tables else sent
    for t in tables[1:]:
        given = given.unionByName(t)
    given = given.groupBy("conv_id", "depth").agg(*(F.sum(s).alias(f"given_{s}") for s in SUMS))
    out = nodes.join(given, ["conv_id", "depth"], "left")
    out = running(out, split, (F.col("depth").desc(),), "sum", {s: F.col(f"own_{s}") + F.coalesce(f"given_{s}", zero()) for s in SUMS}, back=True)
    out = stored(out.drop(*(f"{a}_{s}" for a in ("own", "given") for s in SUMS)), "trie")
    remove(spark, folder)
    return out


def prefix_trie(turns: DataFrame, part_rows: int = PART_ROWS, fan: int = FAN, piece: int = END_PIECE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, n_ends of every node of the trie of rebuilt conversations.

    Rows with a null conv_id belong to no conversation and are left out. Null roles and texts are empty.
    A null turn comes first; rows of one turn are ordered by role, then by the text's MD5; equal rows are
    several turns. A conversation without turns of its own after its head is a member of its head's
    nodes, of the root at least. Ids may be negative: c - c % 20 as SQL has it. Texts are taken whole and do
    not move. An empty table gives no row. Other columns are not read.
    """
    rows = parted(turns, part_rows)
    split = stored(split_conversations(rows), "split")
    steps, ends = rebuilt(rows, split)
    nodes = stored(merged_tries(steps, ends, fan), "nodes")
    up = ["depth", *KEYS]
    below = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up_one").alias("one"), F.col("up_two").alias("two"), "conv_id", F.col("depth").alias("_depth"))
    children = below.groupBy(up).agg(F.count("*").alias("n_children"))
    parents = below.join(apart(nodes.select(*up, F.col("conv_id").alias("parent_conv_id")), *up), up).select("conv_id", F.col("_depth").alias("depth"), "parent_conv_id")
    nodes = nodes.join(children, up, "left").join(end_digests(ends, piece), up, "left").join(parents, ["conv_id", "depth"], "left")
    nodes = nodes.select(
        "conv_id", "part", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero()).alias("n_children"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), F.coalesce("n_ends", zero()).alias("n_ends"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("own_n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved_tokens"),
    )
    out = rolled_up(stored(nodes, "linked"), split)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "n_ends")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY place) AS own FROM turns GROUP BY conv_id),
bits AS (
  SELECT conv_id, own, list_prepend(4294967295, flatten(list_transform(string_split(conv_id::varchar, ''), lambda ch: list_transform(range(8), lambda j: (ascii(ch) >> j) & 1)))) AS b FROM convs),
heads AS (
  SELECT conv_id, own, (xor(list_reduce(b, lambda crc, bit: xor(crc >> 1, CASE WHEN xor(crc, bit) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 4)::int AS h FROM bits),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS seq
  FROM heads a LEFT JOIN convs b ON b.conv_id = a.conv_id - a.conv_id % 20),
steps AS (
  SELECT conv_id, d AS depth, seq[1:d] AS node, d = len(seq) AS last, CASE WHEN d = 0 THEN 0 ELSE len(list_filter(string_split_regex(seq[d].t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) END AS words
  FROM (SELECT conv_id, seq, unnest(generate_series(0, len(seq))) AS d FROM rebuilt)),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256, count(*) FILTER (last) AS n_ends
  FROM steps GROUP BY node, depth),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, count(c.node) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1] LEFT JOIN nodes c ON c.depth = n.depth + 1 AND c.node[1:n.depth] = n.node
  GROUP BY ALL),
below AS (
  SELECT s.node, s.depth, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved_tokens
  FROM linked u JOIN steps s ON s.conv_id = u.conv_id AND s.depth <= u.depth GROUP BY s.node, s.depth)
SELECT conv_id, depth::bigint AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::bigint AS saved_tokens, ends_sha256, n_ends
FROM linked JOIN below USING (node, depth)"""
