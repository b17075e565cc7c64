"""The filter interaction audit against its plain definition, over odd rows and with fingerprints that collide."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from pricelens.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made():
    rng = random.Random(5)
    text = lambda n, v=1000: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    rows = [(1, "same " * 10, "en"), (1, "same " * 10, "en"), (1, "same " * 10, "de"), (2, "same " * 10, None), (3, None, "en"), (4, "", ""), (5, " \n", "en"), (None, "same " * 10, "en"), (None, None, None)]
    rows += [(6, text(250), "en"), (7, text(250, 20), "en"), (8, "A" * 500 + " " + text(220), "de"), (9, text(300) + " #tag", "en"), (10, "x" * 90_000, "fr"), (11, text(30_000), "fr")]
    copies = text(260)
    rows += [(20 + k, copies, rng.choice(["en", "de"])) for k in range(40)] + [(12, copies + "|", "en"), (12, copies, "en"), (-3, copies, "en")]
    rng.shuffle(rows)
    return rows


ROWS = made()
LABELS = [(6, 1, 0), (7, 0, 1), (7, 1, None), (9, None, 1), (21, 1, 1), (22, 0, 0), (None, 1, 1), (99, 1, 1)]


def plain(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    facts = []
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        mark = [any(x[k] == 1 for x in labels if i is not None and x[0] == i) for k in (1, 2)]
        facts.append((lang or "", {f for f in fails if fails[f]}, *mark))
    out, shapley = {}, Counter()
    for part in {f[0] for f in facts}:
        for order in permutations("ABCDE"):
            left = [f for f in facts if f[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [x for x in left if f in x[1]]
                again = sum(f in x[1] for x in gone)
                left = [x for x in left if f not in x[1]]
                gone += now
                out[part, "".join(order), step] = [len(left), len(now), again, sum(x[0] == part and x[1] == {f} for x in facts), sum(x[2] for x in now), sum(x[3] for x in now)]
                shapley[part, f] += len(now)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("fingerprint,lot_chars", [(F.xxhash64, audit.LOT_CHARS), (lambda t: F.length(t) % 3, 300)])
def test_audit(spark, fingerprint, lot_chars):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(5)
    docs = docs.select("*", *(F.lit(0).alias(c) for c in ("_id", "_text", "_mask", "part", "a.b", "good")))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(docs, labels, fingerprint, lot_chars).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[4:] for r in got} == plain(ROWS, LABELS)
    assert len(got) == 600 * 4


def test_hot_text_leaves_a_lot_once():
    rows = [(i, "p", 0, 7, "hot") for i in range(1000, 0, -1)] + [(5, "p", 0, 8, "other")]
    out = list(audit.lots(rows, audit.LOT_CHARS))
    assert sum(r[1][2] is not None for r in out) == 2 and len(out) == 1001


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(docs, labels).count() == 0
