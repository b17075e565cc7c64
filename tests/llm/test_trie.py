"""The conversation trie against its plain definition: odd rows, conversations over many parts, merges of two tables at a time."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pricelens.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made():
    rng = random.Random(3)
    say = lambda: rng.choice(["hello there", "yes", "", None, "a  b\nc", "Élan 日本"])
    rows = []
    for c in [*range(0, 65), -40, -37, -20, -3, 10**12 + 1]:
        for k in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", say()))
    rows = [r for r in rows if r[0] != 20]  # an absent family head
    rows += [(200 + c, k, "user", "the very same") for c in range(40) for k in range(3)]  # a hot conversation
    rows += [(300, k // 2, rng.choice(["user", "tool"]), f"long {k % 7}") for k in range(200)]  # a very long one, with ties
    rows += [(301, None, "user", "null turn"), (301, 0, None, "zero"), (301, None, "system", None), (302, 1, "user", "twice"), (302, 1, "user", "twice"), (None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(303, 0, "user", "word " * 20_000)]
    rng.shuffle(rows)
    return rows


ROWS = made()


def plain(rows):
    turns = defaultdict(list)
    for c, k, role, text in rows:
        if c is not None:
            turns[c].append((k is not None, k or 0, role or "", hashlib.md5((text or "").encode()).digest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in turns.items()}
    whole = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + x[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    own_saved = {v: (len(m) - 1) * len(WORD.findall(v[-1][1])) if v else 0 for v, m in members.items()}
    children = defaultdict(list)
    for v in members:
        if v:
            children[v[:-1]].append(v)
    leaves, saved = defaultdict(int), defaultdict(int)
    for v in sorted(members, key=len, reverse=True):
        leaves[v] = sum(leaves[x] for x in children[v]) or 1
        saved[v] = own_saved[v] + sum(saved[x] for x in children[v])
    out = []
    for v, m in members.items():
        ends = [c for c in m if whole[c] == v]
        out.append((m[0], len(v), members[v[:-1]][0] if v else None, len(m), len(children[v]), leaves[v], saved[v], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(), len(ends)))
    return set(out)


@pytest.mark.parametrize("part_rows,fan,piece", [(trie.PART_ROWS, trie.FAN, trie.END_PIECE), (12, 2, 2)])
def test_trie(spark, part_rows, fan, piece):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(3)
    turns = turns.select("*", *(F.lit("x").alias(c) for c in ("part", "words", "depth", "_row", "tie", "one", "a.b", "conv")))
    got = [tuple(r) for r in trie.prefix_trie(turns, part_rows, fan, piece).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(ROWS)


def test_long_conversations_are_split(spark):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    parts = trie.parted(turns, 12)
    assert parts.groupBy("part").count().agg(F.max("count")).head()[0] < 60
    assert [r.conv_id for r in trie.split_conversations(parts).collect()].count(300) == 1


def test_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
