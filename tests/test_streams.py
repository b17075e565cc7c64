"""Streams with state against batches, timers of the watchdog, and sinks that get a batch twice or fail."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from pricelens.operators import events, intervals
from pricelens.sinks.incremental import EventSinks, Journal, UpsertTable
from pricelens.streaming import stateful

OBSERVED = "offre_id long, observed_at timestamp, k1 long, k2 long, prix_original double, prix_en_promotion double, stock_status string"


def test_changes_over_batches(spark, tmp_path):
    stateful.with_state_store(spark)
    t0 = dt.datetime(2024, 1, 1)
    told = [(1, 0, 10.0, None, "IN_STOCK"), (1, 1, 10.001, None, "IN_STOCK"), (1, 2, 11.0, None, "IN_STOCK"), (1, 3, 11.0, 9.0, "IN_STOCK"), (2, 0, None, None, "RUPTURE"), (2, 5, None, None, None), (2, 6, None, None, None)]
    told += [(3, h, 100.0 + (h % 4) * 1.005, 50.0 if h % 7 == 0 else None, "RUPTURE" if h % 5 == 0 else "IN_STOCK") for h in range(30)] + [(3, 30, 100.0, None, "RUPTURE"), (3, 30, 90.0, None, "IN_STOCK")]
    rows = [(o, t0 + dt.timedelta(hours=h), n, 0, p, q, s) for n, (o, h, p, q, s) in enumerate(told)]
    out = str(tmp_path / "out")
    for cut in (rows[:3] + rows[7:15], rows[3:7] + rows[15:30], rows[30:]):
        spark.createDataFrame(cut, OBSERVED).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(OBSERVED).parquet(str(tmp_path / "in"))
        stateful.changes(stream).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    money = spark.createDataFrame(rows, OBSERVED).withColumns({c: F.col(c).cast("decimal(10,3)") for c in ("prix_original", "prix_en_promotion")})
    whole = intervals.compact(money, order=("observed_at", "k1"), prices=("prix_original", "prix_en_promotion"))
    number = lambda x: None if x is None else float(x)
    got = spark.read.parquet(out).collect()
    assert sorted((r.offre_id, r.run, r.date_detection, number(r.prix_original)) for r in got if r.prix_original) == sorted((r.offre_id, r.run, r.date_debut, number(r.prix_original)) for r in whole.collect() if r.prix_original)
    closed = {(r.offre_id, r.run - 1): r.ferme_nb for r in got if r.run > 1}
    assert closed == {(r.offre_id, r.run): r.nb_observations for r in whole.collect() if r.date_fin is not None}
    key = lambda r: (r.offre_id, r.run, r.type_evenement, number(r.valeur_avant), number(r.valeur_apres))
    assert {key(r) for r in got if r.type_evenement} == {key(r) for r in events.detect(whole).collect()}


def test_folded_batches_tell_what_the_whole_tells(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    told = [(1, 0, 10.0, None, "IN_STOCK"), (1, 1, 10.001, None, "IN_STOCK"), (1, 2, 11.0, None, "IN_STOCK"), (1, 3, 11.0, 9.0, "IN_STOCK"), (2, 0, None, None, "RUPTURE"), (2, 5, None, None, None), (2, 6, None, None, None)]
    told += [(3, h, 100.0 + (h % 4) * 1.005, 50.0 if h % 7 == 0 else None, "RUPTURE" if h % 5 == 0 else "IN_STOCK") for h in range(30)] + [(4, 40, 5.0, None, "IN_STOCK")]
    rows = [(o, t0 + dt.timedelta(hours=h), n, 0, p, q, s) for n, (o, h, p, q, s) in enumerate(told)]
    got = []
    fold = stateful.Folded(spark, str(tmp_path / "open"), lambda events, batch: got.append((batch, events.collect())))
    for batch, cut in enumerate((rows[:3] + rows[7:15], rows[3:7] + rows[15:30], rows[30:])):
        for _ in range(2):  # each comes twice
            fold(spark.createDataFrame(cut, OBSERVED), batch)
    assert all(sorted(map(str, a[1])) == sorted(map(str, b[1])) for a, b in zip(got[::2], got[1::2], strict=True))
    whole = intervals.compact(spark.createDataFrame(rows, OBSERVED), order=("observed_at", "k1"), prices=("prix_original", "prix_en_promotion"))
    key = lambda r: (r.offre_id, r.run, r.type_evenement, r.valeur_avant, r.valeur_apres, r.date_detection)
    assert sorted(map(key, (r for _, e in got[::2] for r in e)), key=str) == sorted(map(key, events.detect(whole).collect()), key=str)
    last = {(r.offre_id, r.run, r.nb, r.date_debut) for r in spark.read.parquet(str(tmp_path / "open/2")).where("last").collect()}
    assert last == {(r.offre_id, r.run, r.nb_observations, r.date_debut) for r in whole.where("date_fin is null").collect()}


def test_watchdog_timers(spark, tmp_path):
    stateful.with_state_store(spark)
    schema = "run_id long, genre string"
    add = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add((1, "debut"), (1, "page"), (2, "debut"), (3, "debut"), (3, "page"), (3, "fin"), (4, "page"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = stateful.watchdog(stream, idle_ms=20_000, young_ms=25_000).writeStream.format("memory").queryName("dogs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        began = time.time()
        while query.lastProgress is None or query.lastProgress["batchId"] < 0 or spark.table("dogs").count() < 1:
            assert time.time() - began < 90
            time.sleep(0.3)
        assert [tuple(r) for r in spark.table("dogs").collect()] == [(3, "TERMINE", 1)]
        add((4, "page"))  # heard of again: its timer starts anew
        while spark.table("dogs").count() < 4:
            assert time.time() - began < 180
            time.sleep(0.3)
    finally:
        query.stop()
    assert sorted(map(tuple, spark.table("dogs").collect())) == [(1, "TERMINE", 1), (2, "ECHOUE", 0), (3, "TERMINE", 1), (4, "TERMINE", 2)]


def test_a_batch_that_comes_twice(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "k long, nom string, prix double, seen long")
    table = UpsertTable(spark, str(tmp_path / "t"), "k long, nom string, prix double", "k", 4)
    assert table.read().count() == 0
    assert table.apply(rows((1, "a", 1.0, 1), (2, "b", 2.0, 1), (None, "x", 0.0, 1)), 0, "seen", ["prix"])
    assert table.apply(rows((1, "z", 5.0, 2), (3, "c", 3.0, 1)), 1, "seen", ["prix"])
    once = sorted(map(tuple, table.read().collect()))
    assert once == [(1, "a", 5.0), (2, "b", 2.0), (3, "c", 3.0)]
    assert not table.apply(rows((1, "z", 5.0, 2), (3, "c", 3.0, 1)), 1, "seen", ["prix"]) and not table.apply(rows((9, "q", 1.0, 1)), 0, "seen", ["prix"])
    # A batch that is lost before its manifest leaves rows that nothing reads.
    rows((1, "lost", 0.0, 1)).selectExpr("k", "nom", "prix", "0 as part").write.partitionBy("part").parquet(str(tmp_path / "t" / "rows" / "version=2"))
    assert sorted(map(tuple, UpsertTable(spark, str(tmp_path / "t"), table.schema, "k", 4).read().collect())) == once
    assert table.apply(rows((2, "b", 7.0, 3)), 2, "seen", ["prix"])
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 5.0), (2, "b", 7.0), (3, "c", 3.0)]


def test_a_side_sink_that_fails(spark, tmp_path):
    down = [True]

    def alerts(df):
        if down[0]:
            raise ValueError("down")
        return df.where("n > 1")

    sinks = EventSinks(Journal(spark, str(tmp_path / "j")), "n long", alerts)
    batch = lambda *x: spark.createDataFrame([(i,) for i in x], "n long")
    sinks(batch(1, 2, 3), 0)
    sinks(batch(1, 2, 3), 0)
    down[0] = False
    sinks(batch(5), 1)
    held = lambda name: sorted(r.n for r in sinks.journal.rows(name, "n long").collect())
    assert held("events") == [1, 2, 3, 5] and held("alerts") == [5] and sinks.missing() == [0]
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "j" / "failures")).collect()] == ["ValueError: down"] * 2
    assert sinks.retry() == [] and held("alerts") == [2, 3, 5] and held("events") == [1, 2, 3, 5]


@pytest.mark.parametrize("before,now,kind", [(None, (1.0, None, "IN_STOCK"), "NOUVELLE_OFFRE_DECOUVERTE"), ((0.0, None, "x"), (5.0, None, "x"), None), ((5.0, None, "x"), (None, None, "x"), None), ((5.0, 0.0, "x"), (5.0, 4.0, "x"), "DEBUT_PROMOTION"), ((100.0, None, "x"), (98.0, None, "x"), "BAISSE_PRIX"), ((100.0, None, None), (102.0, None, None), "HAUSSE_PRIX")])
def test_transitions(before, now, kind):
    assert stateful.event(before, now)[0] == kind
