"""Events from consecutive intervals, and their fan-out to subscribers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S


def event_type(first: Column, stock: Column, before_stock: Column, promo: Column, before_promo: Column, price: Column, before_price: Column, out: Sequence[str] = S.STRICT_OUT) -> Column:
    """The one event of a transition, or null; stock goes before promotion, promotion before price.

    A zero or null promotion counts as none. A null price on either side, or a zero one before, gives
    no price event. Bounds are inclusive.
    """
    gone = F.coalesce(stock.isin(*out), F.lit(False))
    was_gone = F.coalesce(before_stock.isin(*out), F.lit(False))
    on = lambda p: F.coalesce(p != 0, F.lit(False))
    move = F.try_divide(price.cast("double") - before_price.cast("double"), before_price.cast("double"))
    return (
        F.when(first, S.NEW_OFFER)
        .when(gone & ~was_gone, S.OUT_OF_STOCK)
        .when(was_gone & ~gone, S.BACK_IN_STOCK)
        .when(on(promo) & ~on(before_promo), S.PROMO_START)
        .when(move <= -S.PRICE_MOVE, S.PRICE_DROP)
        .when(move >= S.PRICE_MOVE, S.PRICE_RISE)
    )


def told(snapshots: DataFrame, key: str | Sequence[str] = "offre_id", out: Sequence[str] = S.STRICT_OUT, order: Sequence[str] = ("run",)) -> DataFrame:
    """snapshots with the event of each interval: type_evenement (null: none), valeur_avant, valeur_apres.

    The window has the key and order that compaction left, so no further shuffle; nor a sort, if order
    names what the observations were sorted by.
    """
    own = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    before = lambda c: F.lag(c).over(own)
    kind = event_type(
        F.row_number().over(own) == 1, F.col("stock_status"), before("stock_status"), F.col("prix_en_promotion"), before("prix_en_promotion"), F.col("prix_original"), before("prix_original"), out
    )
    rows = snapshots.withColumn("_before", before("prix_original")).withColumn("type_evenement", kind)
    value = F.when(F.col("type_evenement") == S.PROMO_START, F.col("prix_en_promotion")).when(F.col("type_evenement").isNotNull(), F.col("prix_original"))
    return rows.withColumn("valeur_avant", F.when(F.col("type_evenement") != S.NEW_OFFER, F.col("_before"))).withColumn("valeur_apres", value).drop("_before")


def only(rows: DataFrame, *more: str) -> DataFrame:
    """The events of told()'s rows, and more columns of their intervals."""
    return rows.where(F.col("type_evenement").isNotNull()).select(*more, "type_evenement", "valeur_avant", "valeur_apres", F.col("date_debut").alias("date_detection"), "run")


def detect(snapshots: DataFrame, key: str = "offre_id", out: Sequence[str] = S.STRICT_OUT) -> DataFrame:
    """key, type_evenement, valeur_avant, valeur_apres, date_detection, run: at most one row for each interval."""
    return only(told(snapshots, key, out), key)


def fan_out(events: DataFrame, scope: DataFrame, rules: DataFrame, users: DataFrame) -> DataFrame:
    """One row for each event, matching active rule and active user of the rule's tenant.

    events need categorie_id; scope is tenant_id, categorie_id; rules are rule_id, tenant_id,
    type_evenement, categories (empty or null: all), seuil, alert; users are user_id, tenant_id,
    est_actif. A threshold is asked only if it is set and the value before is neither null nor zero;
    a null value after then counts as 0. Two rules that match give two rows. Rules, scope and users
    are a subscriber's settings and are left to the planner to broadcast by size.
    """
    share = F.abs(F.coalesce("valeur_apres", F.lit(0)).cast("double") - F.col("valeur_avant").cast("double")) / F.nullif(F.col("valeur_avant").cast("double"), F.lit(0.0)) * 100
    asked = (F.coalesce("seuil", F.lit(0)) != 0) & (F.coalesce(F.col("valeur_avant").cast("double"), F.lit(0.0)) != 0)
    wanted = F.col("categories").isNull() | (F.size("categories") == 0) | F.array_contains("categories", F.col("categorie_id"))
    active = rules.where("alert").select("rule_id", "tenant_id", "type_evenement", "categories", "seuil")
    people = users.where("est_actif").select("user_id", "tenant_id")
    return events.join(scope, "categorie_id").join(active, ["tenant_id", "type_evenement"]).where(wanted & (~asked | (share >= F.col("seuil")))).join(people, "tenant_id")


def price_delta(after: Column, before: Column) -> tuple[Column, Column]:
    """Absolute change at three decimals, and in percent at one; the latter is null for a zero or null value before."""
    a, b = after.cast("double"), before.cast("double")
    return F.round(a - b, 3), F.round(F.try_divide(a - b, b) * 100, 1)
