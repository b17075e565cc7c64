"""Streams with state: intervals closed and events told as observations come, and a watchdog over runs.

Both are transformWithState operators, whose state lies in RocksDB: with_state_store() sets the session up.
Folded tells the events batch by batch, for streams of many offers: its state is a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S
from .. import storage
from ..operators import events

CHANGE = "offre_id long, run long, type_evenement string, valeur_avant double, valeur_apres double, date_detection timestamp, prix_original double, prix_en_promotion double, stock_status string, ferme_debut timestamp, ferme_nb long"
OPEN = "run long, date_debut timestamp, nb long, original double, promotion double, stock string, rounded double, rounded_promotion double"
ROW = Row(*(c.split()[0] for c in CHANGE.split(", ")))
STATUS = "run_id long, statut string, vus long"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, with the state store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def event(before: tuple | None, now: tuple, out: tuple[str, ...] = S.STRICT_OUT) -> tuple[str | None, float | None, float | None]:
    """type, value before and after of a transition between (price, promotion, stock); the rules are those of operators.events."""
    if before is None:
        return S.NEW_OFFER, None, now[0]
    gone, was_gone = now[2] in out, before[2] in out
    if gone != was_gone:
        return (S.OUT_OF_STOCK if gone else S.BACK_IN_STOCK), before[0], now[0]
    if now[1] and not before[1]:
        return S.PROMO_START, before[0], now[1]
    move = (now[0] - before[0]) / before[0] if before[0] and now[0] is not None else 0.0
    kind = S.PRICE_DROP if move <= -S.PRICE_MOVE else S.PRICE_RISE if move >= S.PRICE_MOVE else None
    return kind, before[0], now[0]


class Changes(StatefulProcessor):
    """The state of an offer is its open interval. Rows of one batch are taken by time; one that comes in a later batch counts as observed then."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", OPEN, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = first = self.open.get() if self.open.exists() else None
        for r in sorted(rows, key=lambda r: (r.observed_at, r.k1, r.k2)):
            told = (r.stock_status, r.arrondi, r.arrondi_promotion)
            if held is not None and tuple(held)[5:] == told:
                held = (*tuple(held)[:2], held[2] + 1, *tuple(held)[3:])
                continue
            now = (r.prix_original, r.prix_en_promotion, r.stock_status)
            kind, was, becomes = event(None if held is None else tuple(held)[3:6], now)
            run = 1 if held is None else held[0] + 1
            yield ROW(key[0], run, kind, was, becomes, r.observed_at, *now, None if held is None else held[1], None if held is None else held[2])
            held = (run, r.observed_at, 1, *now, *told[1:])
        if held is not first:
            self.open.update(held)

    def close(self) -> None:
        pass


def changes(observations: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A row for each observation that opens an interval of its offer: its number, event (null type if it tells none), values, and the
    beginning and the number of observations of the interval that it closes (null for an offer's first).

    observations: offre_id, observed_at, k1, k2 (what orders equal times), prix_original, prix_en_promotion (double), stock_status.
    ttl_ms: an offer that is not observed for so long is forgotten and counts as new again; never, if null.
    """
    rounded = lambda c: F.round(F.col(c).cast("decimal(20,6)"), 2).cast("double")  # noqa: E731  as batches compare prices
    rows = observations.withColumn("arrondi", rounded("prix_original")).withColumn("arrondi_promotion", rounded("prix_en_promotion"))
    return rows.groupBy("offre_id").transformWithState(Changes(ttl_ms), CHANGE, "Append", "ProcessingTime" if ttl_ms else "None")


@dataclass
class Folded:
    """foreachBatch target: tells sink(events, batch) the events of a stream of observations (as changes() takes them), whose open intervals it keeps at path.

    A batch's observations meet the open intervals by windows and no row is handed to Python. A batch that comes again
    starts from the same intervals and overwrites what it left.
    """

    spark: SparkSession
    path: str
    sink: Callable[[DataFrame, int], object]

    def __call__(self, rows: DataFrame, batch: int) -> None:
        held = f"{self.path}/{batch - 1}"
        open_ones = self.spark.read.parquet(held).where("last") if batch and storage.exists(self.spark, held) else None
        folded(open_ones, rows).write.mode("overwrite").parquet(f"{self.path}/{batch}")
        now = self.spark.read.parquet(f"{self.path}/{batch}")
        told = events.detect(now.withColumn("run", F.struct("run", "held")))
        self.sink(told.where("not run.held").withColumn("run", F.col("run.run")), batch)


def folded(held: DataFrame | None, observations: DataFrame) -> DataFrame:
    """offre_id, run, date_debut, nb, prix_original, prix_en_promotion, stock_status, held and last: the intervals that observations open, and those that were held open before (held); last is open now. held: rows of an earlier result."""
    rounded = lambda c: F.round(F.col(c).cast("decimal(20,6)"), 2).cast("double")  # noqa: E731  as batches compare prices
    values = ("prix_original", "prix_en_promotion", "stock_status")
    rows = observations.select("offre_id", F.lit(None).cast("long").alias("before"), F.lit(1).cast("long").alias("n"), F.col("observed_at").alias("at"), "k1", "k2", *values)
    if held is not None:
        rows = rows.unionByName(held.select("offre_id", F.col("run").alias("before"), F.col("nb").alias("n"), F.col("date_debut").alias("at"), *values), allowMissingColumns=True)
    own = Window.partitionBy("offre_id").orderBy(F.col("before").isNull(), "at", "k1", "k2")
    alike = F.col("stock_status").eqNullSafe(F.lag("stock_status").over(own))
    for c in values[:2]:
        alike &= rounded(c).eqNullSafe(F.lag(rounded(c)).over(own))
    opens = F.when(F.col("before").isNotNull() | ((F.row_number().over(own) > 1) & alike), 0).otherwise(1)
    first = F.coalesce(F.first("before").over(own), F.lit(0).cast("long"))
    rows = rows.withColumn("_opens", opens).withColumn("run", first + F.sum("_opens").over(own))
    out = rows.groupBy("offre_id", "run").agg(F.min_by(F.struct("at", *values), F.struct(F.col("before").isNull(), "at", "k1", "k2")).alias("_v"), F.sum("n").alias("nb"), F.count_if(F.col("before").isNotNull()).alias("_held"))
    after = F.lead("run").over(Window.partitionBy("offre_id").orderBy("run"))
    return out.select("offre_id", "run", F.col("_v.at").alias("date_debut"), "nb", *(F.col(f"_v.{c}").alias(c) for c in values), (F.col("_held") > 0).alias("held"), after.isNull().alias("last"))


class Watchdog(StatefulProcessor):
    """A run has one timer: the moment at which it counts as ended unless it is heard of."""

    def __init__(self, idle_ms: int, young_ms: int) -> None:
        self.idle_ms, self.young_ms = idle_ms, young_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "pages long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kinds = pd.concat(list(rows))["genre"]
        pages, due = self.seen.get() if self.seen.exists() else (0, None)
        if due is not None:
            self.handle.deleteTimer(due)
        pages += int((kinds == "page").sum())
        if (kinds == "fin").any():
            self.seen.clear()
            yield pd.DataFrame([(key[0], "TERMINE", pages)], columns=["run_id", "statut", "vus"])
            return
        due = timerValues.getCurrentProcessingTimeInMs() + (self.idle_ms if pages else self.young_ms)
        self.handle.registerTimer(due)
        self.seen.update((pages, due))
        yield pd.DataFrame({"run_id": [], "statut": [], "vus": []}).astype({"run_id": "int64", "statut": "object", "vus": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pages, _ = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame([(key[0], "TERMINE" if pages else "ECHOUE", pages)], columns=["run_id", "statut", "vus"])

    def close(self) -> None:
        pass


def watchdog(activity: DataFrame, idle_ms: int = 60_000, young_ms: int = 120_000) -> DataFrame:
    """run_id, statut, vus: the end of each run of a stream of activity (run_id, genre: debut, page or fin).

    A run that says fin, or has read pages and is silent for idle_ms, is TERMINE; one that is young_ms
    old without a page is ECHOUE. Times are those of processing.
    """
    return activity.groupBy("run_id").transformWithStateInPandas(Watchdog(idle_ms, young_ms), STATUS, "Append", "ProcessingTime")
