"""Event queries: dashboards, market activity and alerts. Scoped ones are those of tenant 1; its own site is 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import events
from ..registry import query
from ..tables import Tables

SCOPED = "fx_event JOIN fx_product USING (produit_id) WHERE categorie_id IN (1, 2, 3)"
LAST = "(SELECT max(observed_at) FROM fx_obs)"


def scoped(t: Tables, own: bool = False) -> DataFrame:
    """Events in scope with their category; those of the own site only if asked for."""
    rows = t.placed_events.where(t.scope(1))
    rows = rows if own else rows.where(F.col("site_id") != t.tenant(1)[3])
    return rows.join(F.broadcast(t.categories), "categorie_id")  # a row a category


def named(t: Tables, rows: DataFrame) -> DataFrame:
    """Rows in scope with the name and brand of their product."""
    return rows.join(t.products.where(t.scope(1)).select("produit_id", "nom", "marque"), "produit_id")


def since(t: Tables, days: int):
    return t.months(days) & (F.col("date_detection") >= t.as_of - F.expr(f"INTERVAL {days} DAYS"))


@query(f"""
SELECT k.type_evenement, coalesce(n, 0) AS n FROM (SELECT unnest({list(S.EVENT_TYPES)}) AS type_evenement) k
LEFT JOIN (SELECT type_evenement, count(*) AS n FROM {SCOPED} AND site_id <> 0 AND date_detection >= {LAST} - INTERVAL 30 DAY GROUP BY 1) USING (type_evenement)""")
def events_summary(t: Tables) -> DataFrame:
    """Events of 30 days by type, zero for those without."""
    counts = scoped(t).where(since(t, 30)).groupBy("type_evenement").agg(F.count("*").alias("n"))
    types = t.spark.createDataFrame([(k,) for k in S.EVENT_TYPES], "type_evenement string")
    return types.join(counts, "type_evenement", "left").select("type_evenement", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"SELECT DISTINCT site_id, slug FROM {SCOPED.replace('WHERE', 'JOIN fx_site USING (site_id) WHERE')} AND site_id <> 0")
def event_sites(t: Tables) -> DataFrame:
    """Other sites with events in scope."""
    return scoped(t).select("site_id").distinct().join(t.sites, "site_id").select("site_id", "slug")


@query(f"""
SELECT offre_id, run, nom, categorie, type_evenement, round(CAST(valeur_apres AS DOUBLE) - CAST(valeur_avant AS DOUBLE), 3) AS delta,
       round((CAST(valeur_apres AS DOUBLE) - CAST(valeur_avant AS DOUBLE)) / nullif(CAST(valeur_avant AS DOUBLE), 0) * 100, 1) AS delta_pct, date_detection
FROM {SCOPED} AND site_id <> 0 AND type_evenement IN ('BAISSE_PRIX', 'HAUSSE_PRIX')""")
def events_list(t: Tables) -> DataFrame:
    """Price events in scope with their change."""
    change, share = events.price_delta(F.col("valeur_apres"), F.col("valeur_avant"))
    rows = named(t, scoped(t).where(F.col("type_evenement").isin(S.PRICE_DROP, S.PRICE_RISE)))
    return rows.select("offre_id", "run", "nom", "categorie", "type_evenement", change.alias("delta"), share.alias("delta_pct"), "date_detection")


@query(f"""
SELECT (SELECT count(DISTINCT produit_id) FROM fx_offer WHERE categorie_id IN (1, 2, 3)) AS produits, (SELECT count(DISTINCT site_id) FROM fx_offer WHERE categorie_id IN (1, 2, 3)) AS sites,
       count(*) FILTER (date_detection >= {LAST} - INTERVAL 7 DAY) AS variations_7j, count(*) FILTER (date_detection >= {LAST} - INTERVAL 1 DAY) AS variations_hier,
       count(*) FILTER (date_detection >= {LAST} - INTERVAL 7 DAY AND type_evenement = 'RUPTURE_STOCK') AS ruptures_7j, max(date_detection) AS dernier
FROM {SCOPED}""")
def dashboard_overview(t: Tables) -> DataFrame:
    """Products and sites in scope, and the events of 7 days and of one; the own site counts."""
    stock = t.placed.where(t.scope(1)).agg(F.countDistinct("produit_id").alias("produits"), F.countDistinct("site_id").alias("sites"))
    told = scoped(t, own=True).agg(
        F.count_if(since(t, 7)).alias("variations_7j"), F.count_if(since(t, 1)).alias("variations_hier"),
        F.count_if(since(t, 7) & (F.col("type_evenement") == S.OUT_OF_STOCK)).alias("ruptures_7j"), F.max("date_detection").alias("dernier"),
    )
    return stock.crossJoin(told)  # one row each


def series(t: Tables, rows: DataFrame, days: int) -> DataFrame:
    """A row for each of the last days, a column of counts for each type, zero where there is none."""
    last = F.to_date(t.as_of)
    calendar = t.spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("jour"))
    counts = rows.where(t.months(days)).withColumn("jour", F.to_date("date_detection")).where(F.col("jour") >= F.date_sub(last, days - 1))
    return calendar.join(counts.groupBy("jour").pivot("type_evenement", list(S.EVENT_TYPES)).count(), "jour", "left").na.fill(0)


def series_sql(days: int, rest: str) -> str:
    counts = ", ".join(f"count(*) FILTER (type_evenement = '{k}') AS {k}" for k in S.EVENT_TYPES)
    return f"""
SELECT jour, {counts} FROM (SELECT CAST(unnest(generate_series({LAST} - INTERVAL {days - 1} DAY, {LAST}, INTERVAL 1 DAY)) AS DATE) AS jour)
LEFT JOIN (SELECT CAST(date_detection AS DATE) AS jour, type_evenement FROM {SCOPED} {rest}) USING (jour) GROUP BY jour"""


@query(series_sql(7, ""))
def dashboard_trends(t: Tables) -> DataFrame:
    """Events of each of 7 days, the own site's too."""
    return series(t, scoped(t, own=True), 7)


@query(series_sql(30, "AND site_id <> 0"))
def market_activity(t: Tables) -> DataFrame:
    """The other sites' events of each of 30 days."""
    return series(t, scoped(t), 30)


@query("SELECT offre_id, nom, slug, date_debut FROM fx_offer JOIN fx_site USING (site_id) WHERE categorie_id IN (1, 2, 3) AND site_id <> 0 AND stock_status = 'RUPTURE' ORDER BY date_debut DESC, offre_id LIMIT 10")
def competitor_ruptures(t: Tables) -> DataFrame:
    """The ten other offers that ran out last."""
    rows = t.offers.where(t.scope(1) & (F.col("site_id") != t.tenant(1)[3]) & F.col("stock_status").isin(*S.STRICT_OUT)).join(t.sites, "site_id")
    return rows.orderBy(F.desc("date_debut"), "offre_id").limit(10).select("offre_id", "nom", "slug", "date_debut")


RECENT = f"{SCOPED} AND site_id <> 0 AND date_detection >= {LAST} - INTERVAL 30 DAY"
NAMED = RECENT.replace("WHERE", "JOIN fx_site USING (site_id) WHERE")


@query(f"""
WITH cell AS (SELECT categorie, slug, count(*) AS n FROM {NAMED} GROUP BY 1, 2),
top AS (SELECT categorie, sum(n) AS total FROM cell GROUP BY 1 ORDER BY total DESC, categorie LIMIT 10),
kept AS (SELECT cell.* FROM cell JOIN top USING (categorie))
SELECT categorie, slug, coalesce(n, 0) AS n, CAST(floor(coalesce(n, 0) / max(n) OVER () * 100) AS BIGINT) AS intensite
FROM top CROSS JOIN (SELECT DISTINCT slug FROM kept) LEFT JOIN kept USING (categorie, slug)""")
def market_heatmap(t: Tables, limit: int = 10) -> DataFrame:
    """The other sites' events of 30 days, of each of the most active categories and each site, in hundredths of the
    greatest count, truncated; zero where there are none."""
    cells = scoped(t).where(since(t, 30)).groupBy("categorie", "site_id").agg(F.count("*").alias("n")).join(t.sites, "site_id")
    # From here on a row a category, its sites (as many as there are) in a map.
    rows = cells.groupBy("categorie").agg(F.sum("n").alias("_total"), F.map_from_entries(F.collect_list(F.struct("slug", "n"))).alias("_cells"))
    top = rows.orderBy(F.desc("_total"), "categorie").limit(limit)
    whole = Window.partitionBy()  # over limit rows
    out = top.withColumn("_most", F.max(F.array_max(F.map_values("_cells"))).over(whole)).withColumn("_slugs", F.array_distinct(F.flatten(F.collect_list(F.map_keys("_cells")).over(whole))))
    n = F.coalesce(F.element_at("_cells", F.col("slug")), F.lit(0).cast("long"))
    return out.withColumn("slug", F.explode("_slugs")).select("categorie", "slug", n.alias("n"), F.floor(n / F.col("_most") * 100).cast("long").alias("intensite"))


@query(f"SELECT categorie, count(*) AS n FROM {RECENT} GROUP BY categorie ORDER BY n DESC, categorie LIMIT 3")
def trends_categories(t: Tables, limit: int = 3) -> DataFrame:
    """The categories with the most events of 30 days; of equals the first by name."""
    rows = scoped(t).where(since(t, 30)).groupBy("categorie").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "categorie").limit(limit)


@query(f"SELECT slug, count(*) FILTER (type_evenement = 'BAISSE_PRIX') AS baisses, count(*) FILTER (type_evenement = 'DEBUT_PROMOTION') AS promos FROM {NAMED} GROUP BY slug ORDER BY baisses DESC, slug LIMIT 3")
def trends_competitors(t: Tables, limit: int = 3) -> DataFrame:
    """The other sites with the most price drops of 30 days, and their new promotions."""
    kind = F.col("type_evenement")
    rows = scoped(t).where(since(t, 30)).join(t.sites, "site_id").groupBy("slug").agg(F.count_if(kind == S.PRICE_DROP).alias("baisses"), F.count_if(kind == S.PROMO_START).alias("promos"))
    return rows.orderBy(F.desc("baisses"), "slug").limit(limit)


@query(f"SELECT offre_id, min(nom) AS nom, count(*) AS n FROM {RECENT} GROUP BY offre_id ORDER BY n DESC, offre_id LIMIT 3")
def trends_volatile(t: Tables, limit: int = 3) -> DataFrame:
    """The other sites' offers with the most events of 30 days."""
    rows = named(t, scoped(t).where(since(t, 30))).groupBy("offre_id").agg(F.min("nom").alias("nom"), F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "offre_id").limit(limit)


@query(f"""
SELECT slug, coalesce(b, 0) AS baisses, coalesce(p, 0) AS promos, coalesce(b, 0) + coalesce(p, 0) AS agressivite FROM fx_site
LEFT JOIN (SELECT site_id, count(*) AS b FROM {SCOPED} AND type_evenement = 'BAISSE_PRIX' AND date_detection >= {LAST} - INTERVAL 7 DAY GROUP BY 1) USING (site_id)
LEFT JOIN (SELECT site_id, count(*) AS p FROM fx_offer WHERE categorie_id IN (1, 2, 3) AND en_promo GROUP BY 1) USING (site_id) WHERE site_id <> 0""")
def competitor_activity(t: Tables) -> DataFrame:
    """Price drops of 7 days and current promotions of each other site; those with neither have zeros."""
    drops = scoped(t).where(since(t, 7) & (F.col("type_evenement") == S.PRICE_DROP)).groupBy("site_id").agg(F.count("*").alias("b"))
    promos = t.placed.where(t.scope(1) & F.col("en_promo")).groupBy("site_id").agg(F.count("*").alias("p"))
    rows = t.sites.where(F.col("site_id") != t.tenant(1)[3]).join(drops, "site_id", "left").join(promos, "site_id", "left")
    b, p = F.coalesce("b", F.lit(0)), F.coalesce("p", F.lit(0))
    return rows.select("slug", b.alias("baisses"), p.alias("promos"), (b + p).alias("agressivite"))


FANNED = """
SELECT e.offre_id, e.run, r.rule_id, u.user_id FROM fx_event e JOIN fx_product p USING (produit_id)
JOIN (VALUES (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, 4), (2, 5), (2, 6)) s(tenant_id, categorie_id) ON s.categorie_id = p.categorie_id
JOIN (VALUES (1, 1, 'BAISSE_PRIX', NULL, 5), (2, 1, 'RUPTURE_STOCK', [1, 2], NULL), (3, 1, 'BAISSE_PRIX', NULL, NULL), (4, 2, 'DEBUT_PROMOTION', NULL, NULL), (5, 2, 'HAUSSE_PRIX', [4], 3)) r(rule_id, tenant_id, type_evenement, categories, seuil)
  ON r.tenant_id = s.tenant_id AND r.type_evenement = e.type_evenement
JOIN (VALUES (1, 1), (2, 1), (4, 2), (5, 3)) u(user_id, tenant_id) ON u.tenant_id = s.tenant_id
WHERE (r.categories IS NULL OR list_contains(r.categories, p.categorie_id))
  AND (coalesce(r.seuil, 0) = 0 OR coalesce(e.valeur_avant, 0) = 0 OR abs(coalesce(CAST(e.valeur_apres AS DOUBLE), 0) - CAST(e.valeur_avant AS DOUBLE)) / CAST(e.valeur_avant AS DOUBLE) * 100 >= r.seuil)"""


@query(FANNED)
def alert_fan_out(t: Tables) -> DataFrame:
    """A notification for each event, rule that it meets, and active user."""
    return fanned(t, t.placed_events).select("offre_id", "run", "rule_id", "user_id")


def fanned(t: Tables, rows: DataFrame) -> DataFrame:
    """rows (of placed_events) for each rule that they meet and active user. The settings are a few rows each: they go to the events, which would meet by category and tenant in a few tasks."""
    return events.fan_out(rows, F.broadcast(t.scopes), F.broadcast(t.rules), F.broadcast(t.users))


@query(f"SELECT user_id, count(*) AS n FROM ({FANNED}) GROUP BY user_id")
def alert_unread(t: Tables) -> DataFrame:
    """Notifications of each user."""
    return alert_fan_out(t).groupBy("user_id").agg(F.count("*").alias("n"))
