"""The n-gram Jaccard join against all pairs: odd rows, groups that links join in part, and bounds far below the data's size."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset({tuple(w)} - {()})


def plain(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in sets}
    links = [(i, j) for n, (i, x) in enumerate(sets) for j, y in sets[n + 1 :] if i is not None and j is not None and i != j and x and y and 100 * len(x & y) >= percent * len(x | y)]
    for _ in range(len(label)):
        before = dict(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    return sorted((i is None, i or 0, len(x), label[i] if i is not None else None) for i, x in sets)


def made():
    rng = random.Random(9)
    text = lambda n, v=4000: [f"w{rng.randrange(v)}" for _ in range(n)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one two three four"), (7, "ONE two three  four"), (8, "Élan É élan x y"), (None, "one two"), (None, None), (9, "x" * 70_000), (10, " ".join(text(20_000)))]
    long = WORD.findall(rows[-1][1])
    rows += [(11, " ".join(long[:19_500] + text(200))), (12, " ".join(long[:16_000])), (10, "a second text of the same id"), (13, "a second text of the SAME id")]
    for g in range(3):  # groups around the threshold, from a few changed words to many
        base = text(140)
        for _ in range(40):
            w = list(base)
            for k in rng.sample(range(140), rng.choice([0, 1, 2, 2, 3, 4, 5, 6, 9])):
                w[k] = f"e{rng.randrange(10**6)}"
            w = w[rng.choice([0, 0, 3, 8]) :]
            rows.append((100 + len(rows), " ".join(w)))
    passage = text(90)
    rows += [(400 + k, " ".join(text(60) + passage + text(rng.randrange(40)))) for k in range(30)]  # a shared passage, no links
    rows += [(500 + k, " ".join(text(rng.randrange(1, 12), 5))) for k in range(60)]  # short texts of few words
    rows += [(600 + k, " ".join(passage)) for k in range(25)]  # copies
    rng.shuffle(rows)
    return rows


ROWS = made()


@pytest.mark.parametrize("block,cell_bits,percent", [(ngram_join.BLOCK, ngram_join.CELL_BITS, 85), (5, 4, 85), (1024, 10, 60)])
def test_join(spark, block, cell_bits, percent):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    docs = docs.select("*", *(F.lit("x").alias(c) for c in ("node", "n", "band", "label", "a.b", "tokens", "n_shingles")))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs, block=block, cell_bits=cell_bits, percent=percent).collect())
    assert got == plain(ROWS, percent)
    if percent == 85:
        parts = defaultdict(int)
        for _, _, _, c in got:
            parts[c] += 1
        assert 40 > max(n for c, n in parts.items() if c is not None and c < 400) > 3


def test_merged_counts(spark):
    """Levels of cells are those of plain counts, however many tables a merge adds."""
    from pricelens.llm._words import slices
    from pricelens.llm.minhash import shingles as sets_of
    import pyarrow as pa

    texts = [t for _, t in ROWS if t]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "node long, text string").repartition(7)
    for bits in (12, 18):
        count = np.zeros(1 << bits, np.int64)
        for w in slices(pa.array(texts)):
            np.add.at(count, (sets_of(w, 4)[0] >> np.uint64(64 - bits)).astype(np.int64), 1)
        level = np.searchsorted(np.array(ngram_join.LEVELS), count, side="right")
        got = ngram_join.cell_levels(df, 4, bits, fan=2)
        assert (np.stack([got & 15, got >> 4], axis=1).ravel() == level).all()


def test_empty(spark):
    for rows in ([], [(1, None)], [(1, None), (2, "")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(tuple(r) for r in ngram_join.jaccard_join(df).collect()) == [(i, 0, i) for i, _ in rows]
