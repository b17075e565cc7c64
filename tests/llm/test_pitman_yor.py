"""The Pitman-Yor model against exact posteriors of small cases."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pricelens.llm import pitman_yor

HELD = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 == 2]
TRAIN = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 != 2]


def stirling(n: int, d: float) -> list[float]:
    row = [1.0]
    for m in range(n):
        row = [(row[t - 1] if t else 0.0) + ((m - t * d) * row[t] if t < len(row) else 0.0) for t in range(m + 2)]
    return row


def rising(a: float, d: float, n: int) -> float:
    return math.prod(a + d * i for i in range(n))


def exact(texts: list[list[str]], asked: set[tuple]) -> dict[tuple, float]:
    """Predictive probabilities of words after contexts, by the sum over all numbers of tables."""
    (d, theta), (d0, theta0) = pitman_yor.CONTEXT, pitman_yor.ROOT
    n = Counter(p for t in texts for p in zip([None, *t], [*t, None]))
    pairs, words = sorted(n, key=str), sorted({w for _, w in n}, key=str)
    share = 1 / (len(words) + 1)
    own, sums, whole = {c: sum(n[p] for p in pairs if p[0] == c) for c, _ in pairs}, defaultdict(float), 0.0
    for ts in itertools.product(*(range(1, n[p] + 1) for p in pairs)):
        t, held, up = dict(zip(pairs, ts)), Counter(), Counter()
        for (c, w), k in t.items():
            held[c] += k
            up[w] += k
        below = math.prod(stirling(n[p], d)[t[p]] for p in pairs) * math.prod(rising(theta, d, held[c]) for c in own)
        customers = sum(up.values())
        for t0 in itertools.product(*(range(1, up[w] + 1) for w in words)):
            top = sum(t0)
            weight = below * math.prod(stirling(up[w], d0)[k] * share**k for w, k in zip(words, t0)) * rising(theta0, d0, top) / rising(theta0, 1, customers)
            whole += weight
            tables = dict(zip(words, t0))
            for c, w in asked:
                parent = (up[w] - d0 * tables.get(w, 0) + (theta0 + d0 * top) * share) / (theta0 + customers)
                sums[c, w] += weight * (n[c, w] - d * t.get((c, w), 0) + (theta + d * held[c]) * parent) / (theta + own.get(c, 0))
    return {p: s / whole for p, s in sums.items()}


TEXTS = ["a b a b a b", "b b", "a b"]


def test_gibbs_agrees_with_exact_posterior():
    """Sweeps as score() makes them, many of them."""
    (d, theta), (d0, theta0) = pitman_yor.CONTEXT, pitman_yor.ROOT
    texts = [t.split() for t in TEXTS]
    n = Counter(p for t in texts for p in zip([None, *t], [*t, None]))
    words, pairs = [None, "a", "b"], list(n)
    asked = {(c, w) for c in words for w in [*words, "unknown"]}
    c, w = (np.array([words.index(p[k]) for p in pairs]) for k in (0, 1))
    count, own = np.array(list(n.values())), np.bincount(c, list(n.values()), 3)
    rng, top, t, sums, sweeps = np.random.default_rng(3), 3, np.ones(len(pairs), int), dict.fromkeys(asked, 0.0), 6000
    for sweep in range(sweeps + 10):
        customers, held = np.bincount(w, t, 3).astype(int), np.bincount(c, t, 3).astype(int)
        y = rng.gamma(theta0 / d0 + top)
        tables, measure, x = pitman_yor.reseat_upper(customers, held, np.ones(3), y, 3, rng)
        total, top = measure.sum() + pitman_yor.unseated(1, y / 4, d0, rng)[0], int(tables.sum())
        if sweep >= 10:
            upper = (np.append(customers - d0 * tables, 0) + (theta0 + d0 * top) / 4) / (theta0 + customers.sum())
            seats = dict(zip(pairs, t))
            for p in asked:
                k, at = words.index(p[0]), words.index(p[1]) if p[1] in words else 3
                sums[p] += (n[p] - d * seats.get(p, 0) + (theta + d * held[k]) * upper[at]) / (theta + own[k])
        t = pitman_yor.reseat(count, np.log(x)[c], np.log(measure)[w], total, rng)
    for p, wanted in exact(texts, asked).items():
        assert sums[p] / sweeps == pytest.approx(wanted, rel=0.03), p


def test_scores_agree_with_exact_posterior(spark):
    rows = [*zip(TRAIN, TEXTS), *zip(HELD, ["a", "b a", "b b b", "c", "a c b", "a b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    tokens = {i: list(zip([None, *t.split()], [*t.split(), None])) for i, t in rows}
    p = exact([t.split() for t in TEXTS], {x for w in tokens.values() for x in w})
    got = {r.doc_id: r.score for r in pitman_yor.score(docs, burn_in=2, samples=6).collect()}
    for i, w in tokens.items():  # six samples: a tenth for each token
        assert got[i] == pytest.approx(sum(math.log10(p[x]) for x in w), abs=0.08 * len(w)), (w, i)


def test_rare_words_have_restaurants(spark):
    """Two words of equal counts and spelling class, beyond any fixed list of frequent ones: only one follows the rare context."""
    common = " ".join(f"w{i} w{i} w{i} w{i} w{i}" for i in range(2500))
    train = [common, "xax yay", "xax yay", "xax yay", "r yby", "s yby", "t yby"]
    rows = [*zip(TRAIN, train), (HELD[0], "xax yay"), (HELD[1], "xax yby")]
    got = {r.doc_id: r for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[HELD[0]].base_score == pytest.approx(got[HELD[1]].base_score)
    assert got[HELD[0]].score > got[HELD[1]].score + 0.5


def test_numbers_of_tables():
    rng = np.random.default_rng(1)
    for n, a, d in ((2, 0.3, 0.6), (40, 3.0, 0.6), (120, 0.7, 0.5), (120, 25.0, 0.6)):
        weights = np.array(stirling(n, d)) * a ** np.arange(n + 1.0)
        mean = weights @ np.arange(n + 1) / weights.sum()
        spread = math.sqrt(weights @ (np.arange(n + 1) - mean) ** 2 / weights.sum())
        for most in {n, pitman_yor.EXACT} if n == 2 else {1, pitman_yor.EXACT}:
            got = pitman_yor.draw_tables(np.full(600, n), np.full(600, math.log(a)), d, rng, exact=most)
            assert abs(got.mean() - mean) < 5 * spread / math.sqrt(600), (n, a, most)
            assert abs(got.std() - spread) < 0.2 * spread + 0.02
    left = pitman_yor.unseated(20_000, 1.7, 0.5, rng)
    assert left.mean() == pytest.approx(1.7 * 0.5, rel=0.05) and np.exp(-left).mean() == pytest.approx(math.exp(-1.7 * (2**0.5 - 1)), rel=0.02)
