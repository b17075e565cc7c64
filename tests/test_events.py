"""Compaction and event detection on hand-made rows."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from pricelens import schemas as S
from pricelens.operators import events, intervals

DAY = datetime(2024, 1, 1)


def observed(spark, *rows):
    """(price, promo, stock) of one offer, a day each."""
    money = lambda x: None if x is None else Decimal(str(x))
    return spark.createDataFrame([(1, DAY + timedelta(days=i), money(p), money(q), None, s) for i, (p, q, s) in enumerate(rows)], S.OBSERVATION)


CASES = [
    ((100, None, "IN_STOCK"), (98, None, "IN_STOCK"), S.PRICE_DROP),
    ((100, None, "IN_STOCK"), (102, None, "IN_STOCK"), S.PRICE_RISE),
    ((100, None, "IN_STOCK"), (99, None, "IN_STOCK"), None),
    ((100, None, "IN_STOCK"), (101, None, "IN_STOCK"), None),
    ((100, None, "IN_STOCK"), (80, None, "RUPTURE"), S.OUT_OF_STOCK),
    ((100, None, "RUPTURE"), (80, None, "IN_STOCK"), S.BACK_IN_STOCK),
    ((100, None, "IN_STOCK"), (80, 70, "IN_STOCK"), S.PROMO_START),
    ((100, 90, "IN_STOCK"), (100, 80, "IN_STOCK"), None),
    ((100, 90, "IN_STOCK"), (100, None, "IN_STOCK"), None),
    ((None, None, "IN_STOCK"), (100, None, "IN_STOCK"), None),
    ((100, None, "IN_STOCK"), (None, None, "IN_STOCK"), None),
    ((0, None, "IN_STOCK"), (100, None, "IN_STOCK"), None),
    ((100, None, "IN_STOCK"), (100, None, "OUT_OF_STOCK"), None),
]


@pytest.mark.parametrize("before, after, kind", CASES)
def test_transition(spark, before, after, kind):
    got = [r.type_evenement for r in events.detect(intervals.compact(observed(spark, before, after))).orderBy("run").collect()]
    assert got == [S.NEW_OFFER] + [kind] * (kind is not None)


def test_wide_stock_words(spark):
    rows = intervals.compact(observed(spark, (100, None, "IN_STOCK"), (100, None, "OUT_OF_STOCK")))
    assert [r.type_evenement for r in events.detect(rows, out=S.WIDE_OUT).orderBy("run").collect()] == [S.NEW_OFFER, S.OUT_OF_STOCK]


def test_compaction(spark):
    got = intervals.compact(observed(spark, (100, None, None), (100.004, None, None), (100.006, None, None), (100, None, None), (None, None, None), (None, None, None))).orderBy("run").collect()
    assert [(r.nb_observations, None if r.prix_original is None else float(r.prix_original)) for r in got] == [(2, 100.0), (1, 100.006), (1, 100.0), (2, None)]
    assert [r.date_fin for r in got[:-1]] == [r.date_debut for r in got[1:]] and got[-1].date_fin is None


def test_empty(spark):
    assert events.detect(intervals.compact(observed(spark))).count() == 0
