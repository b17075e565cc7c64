"""The kept history: what its making moves, and what it holds."""

import shutil

from conftest import SMALL
from pyspark.sql import functions as F

from pricelens import plans, registry  # noqa: F401
from pricelens.operators import events, intervals
from pricelens.tables import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_move_once(spark, monkeypatch):
    """Order lines are dealt out by part, and neither intervals nor events move or sort them again."""
    monkeypatch.setattr("pricelens.tables.TASK_BYTES", 1 << 10)
    for t in (Tables(spark, SMALL), Tables(spark, SMALL)):
        text = plan(t.told)
        assert text.count("hashpartitioning(l_partkey") == 1 and "hashpartitioning(offre_id" not in text and "SortMergeJoin" not in text
        assert text.count("Sort [produit_id") == 1 and text.count(" Sort [") == 1
        monkeypatch.setattr("pricelens.tables.TASK_BYTES", 1 << 40)


def test_more_tasks_for_more_lines(spark, monkeypatch):
    monkeypatch.setattr("pricelens.tables.TASK_BYTES", 1 << 10)
    t = Tables(spark, SMALL)
    assert t.observed.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert t.compacted.exceptAll(Tables(spark, SMALL).snapshots.select(t.compacted.columns)).isEmpty()


def test_kept_is_what_operators_tell(spark):
    t = Tables(spark, SMALL)
    whole = intervals.compact(t.observations, order=("observed_at", "k1", "k2"))
    assert whole.exceptAll(t.snapshots.select(whole.columns)).isEmpty() and t.snapshots.count() == whole.count()
    told = events.detect(whole)
    assert told.exceptAll(t.events.select(told.columns)).isEmpty() and t.events.count() == told.count()


def test_months_lose_no_day(spark):
    t = Tables(spark, SMALL)
    for days in (1, 30, 200, 900, 4000):
        since = F.col("date_detection") >= t.as_of - F.expr(f"INTERVAL {days} DAYS")
        assert t.events.where(since & t.months(days)).count() == t.events.where(since).count() > 0


def test_no_category_no_offer(spark, tmp_path):
    """A part without a type has offers and events, but none that a category is asked of."""
    shutil.copytree(SMALL, tmp_path / "t")
    part = spark.read.parquet(f"{SMALL}/part.parquet").withColumn("p_type", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")))
    (tmp_path / "t" / "part.parquet").unlink()
    part.write.parquet(str(tmp_path / "t" / "part.parquet"))
    t = Tables(spark, str(tmp_path / "t"))
    assert t.current.where("produit_id % 2 = 1").count() > 0
    assert t.placed.where("produit_id % 2 = 1").count() == 0 and t.offers.count() == t.placed.count() > 0
    assert registry.QUERIES["alert_fan_out"](t).where("offre_id div 10 % 2 = 1").count() == 0


def test_settings_go_to_events(spark):
    """Events are not dealt out by category, tenant or type, of which there are a few."""
    t = Tables(spark, SMALL)
    for name in ("alert_fan_out", "rule_triggers", "alert_inbox"):
        text = plan(registry.QUERIES[name](t))
        assert not any(f"hashpartitioning({c}" in text for c in ("categorie_id", "tenant_id", "produit_id", "offre_id"))
