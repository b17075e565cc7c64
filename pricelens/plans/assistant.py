"""Queries of the assistant and of alert rules. Scoped ones are those of tenant 1; a request's filters are arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import labels
from ..operators import events
from ..registry import query
from ..tables import Tables
from .activity import FANNED, LAST, SCOPED, fanned, named, scoped, since
from .analysis import site_rows


def double(c: str):
    return F.col(c).cast("double").alias(c)


@query(f"""
SELECT (SELECT count(*) FROM fx_offer WHERE categorie_id IN (1, 2, 3)) AS offres_total, (SELECT count(DISTINCT site_id) FROM fx_offer WHERE categorie_id IN (1, 2, 3)) AS sites_actifs,
       (SELECT count(*) FROM {SCOPED} AND date_detection >= {LAST} - INTERVAL 7 DAY) AS evenements_7j, (SELECT count(*) FROM fx_offer WHERE categorie_id IN (1, 2, 3) AND en_promo) AS promos_actives,
       (SELECT count(*) FROM fx_offer WHERE categorie_id IN (1, 2, 3) AND stock_status = 'RUPTURE') AS ruptures_stock""")
def market_overview(t: Tables) -> DataFrame:
    """Offers, sites, events of 7 days, promotions and offers out of stock in scope."""
    offers = t.placed.where(t.scope(1)).agg(F.count("*").alias("offres_total"), F.countDistinct("site_id").alias("sites_actifs"), F.count_if("en_promo").alias("promos_actives"), F.count_if(F.col("stock_status").isin(*S.STRICT_OUT)).alias("ruptures_stock"))
    week = scoped(t, own=True).where(since(t, 7)).agg(F.count("*")).scalar()
    return offers.withColumn("evenements_7j", week)


def events_page(t: Tables, types: tuple[str, ...] = (), categories: tuple[int, ...] = (), sites: tuple[str, ...] = (), text: str | None = None, days: int | None = None, first: str | None = None, last: str | None = None, own: bool = False, page: int = 1, limit: int = 10) -> DataFrame:
    """A page of events in scope, latest first, with total and pages. A filter that is not given asks nothing; first and last are days (YYYY-MM-DD), both included, and a day that is none raises."""
    rows = named(t, scoped(t, own)).join(t.sites, "site_id")
    if types:
        rows = rows.where(F.col("type_evenement").isin(*types))
    if categories:
        rows = rows.where(F.col("categorie_id").isin(*categories))
    if sites:
        rows = rows.where(F.col("slug").isin(*sites))
    if text:
        rows = rows.where(F.col("nom").ilike(f"%{text}%") | F.col("marque").ilike(f"%{text}%"))
    if days:
        rows = rows.where(since(t, days))
    if first:
        rows = rows.where(F.col("date_detection") >= F.lit(first).cast("date"))
    if last:
        rows = rows.where(F.col("date_detection") < F.date_add(F.lit(last).cast("date"), 1))
    total = rows.agg(F.count("*")).scalar()
    _, share = events.price_delta(F.col("valeur_apres"), F.col("valeur_avant"))
    shown = rows.orderBy(F.desc("date_detection"), F.desc("offre_id"), F.desc("run")).offset((page - 1) * limit).limit(limit)
    return shown.select("offre_id", "run", "type_evenement", "date_detection", "nom", "slug", double("valeur_avant"), double("valeur_apres"), share.alias("variation_pct"), total.alias("total"), F.ceil(total / limit).cast("long").alias("pages"))


@query(f"""
SELECT offre_id, run, type_evenement, date_detection, nom, slug, CAST(valeur_avant AS DOUBLE) AS valeur_avant, CAST(valeur_apres AS DOUBLE) AS valeur_apres,
       round((CAST(valeur_apres AS DOUBLE) - CAST(valeur_avant AS DOUBLE)) / nullif(CAST(valeur_avant AS DOUBLE), 0) * 100, 1) AS variation_pct, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 10) AS BIGINT) AS pages
FROM {SCOPED.replace('WHERE', 'JOIN fx_site USING (site_id) WHERE')} ORDER BY date_detection DESC, offre_id DESC, run DESC LIMIT 10""")
def recent_events(t: Tables) -> DataFrame:
    """The ten latest events in scope."""
    return events_page(t, own=True)


@query(f"""
SELECT * FROM (SELECT offre_id, run, type_evenement, date_detection, nom, slug, CAST(valeur_avant AS DOUBLE) AS valeur_avant, CAST(valeur_apres AS DOUBLE) AS valeur_apres,
       round((CAST(valeur_apres AS DOUBLE) - CAST(valeur_avant AS DOUBLE)) / nullif(CAST(valeur_avant AS DOUBLE), 0) * 100, 1) AS variation_pct, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 5) AS BIGINT) AS pages
FROM {SCOPED.replace('WHERE', 'JOIN fx_site USING (site_id) WHERE')} AND site_id <> 0 AND type_evenement IN ('BAISSE_PRIX', 'RUPTURE_STOCK') AND categorie_id IN (1, 2) AND slug IN ('asia', 'europe') AND (nom ILIKE '%a%' OR marque ILIKE '%a%')
  AND CAST(date_detection AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1997-12-31') ORDER BY date_detection DESC, offre_id DESC, run DESC LIMIT 5 OFFSET 5""")
def filtered_events(t: Tables) -> DataFrame:
    """The second page of events under all filters."""
    return events_page(t, (S.PRICE_DROP, S.OUT_OF_STOCK), (1, 2), ("asia", "europe"), "a", None, "1995-01-01", "1997-12-31", page=2, limit=5)


@query("""
SELECT produit_id, min(nom) AS nom, min(marque) AS marque, round(CAST(min(prix_original) AS DOUBLE), 2) AS prix_min, round(CAST(max(prix_original) AS DOUBLE), 2) AS prix_max, count(DISTINCT site_id) AS nb_sites
FROM fx_offer WHERE categorie_id IN (1, 2, 3) AND nom ILIKE '%gear%' GROUP BY produit_id ORDER BY produit_id LIMIT 5""")
def product_search(t: Tables, text: str = "gear", limit: int = 5) -> DataFrame:
    """Products in scope whose name has a text, with their price range and sites; the first by number."""
    price = lambda f, name: F.round(f("prix_original").cast("double"), 2).alias(name)
    told = t.placed.where(t.scope(1)).groupBy("produit_id").agg(price(F.min, "prix_min"), price(F.max, "prix_max"), F.countDistinct("site_id").alias("nb_sites"))
    names = t.products.where(t.scope(1) & F.col("nom").ilike(f"%{text}%")).select("produit_id", "nom", "marque")
    return names.join(told, "produit_id").orderBy("produit_id").limit(limit)


@query("SELECT offre_id, nom, marque, slug FROM fx_offer JOIN fx_site USING (site_id) WHERE categorie_id IN (1, 2, 3) AND site_id <> 0 AND stock_status = 'RUPTURE' ORDER BY nom, offre_id LIMIT 20")
def stock_ruptures(t: Tables) -> DataFrame:
    """The other sites' offers that are out of stock, twenty by name."""
    rows = t.offers.where(t.scope(1) & (F.col("site_id") != t.tenant(1)[3]) & F.col("stock_status").isin(*S.STRICT_OUT)).join(t.sites, "site_id")
    return rows.orderBy("nom", "offre_id").limit(20).select("offre_id", "nom", "marque", "slug")


OVER = "SELECT produit_id, own, market, round((own - market) / market * 100, 1) AS ecart_pct FROM (SELECT produit_id, CAST(min(CASE WHEN site_id = 0 THEN prix_original END) AS DOUBLE) AS own, avg(CASE WHEN site_id <> 0 THEN CAST(prix_original AS DOUBLE) END) AS market FROM fx_offer WHERE categorie_id IN (1, 2, 3) GROUP BY 1) WHERE own IS NOT NULL AND market IS NOT NULL"


@query(f"SELECT produit_id, own, round(market, 6) AS market, ecart_pct FROM ({OVER}) WHERE own >= 1.05 * market ORDER BY ecart_pct DESC, produit_id LIMIT 5")
def overpriced_products(t: Tables) -> DataFrame:
    """The five dearer products that are farthest above the market."""
    gap = F.round((F.col("own") - F.col("market")) / F.col("market") * 100, 1).alias("ecart_pct")
    rows = site_rows(t).where("position = 'plus_cher'").select("produit_id", "own", F.round("market", 6).alias("market"), gap)
    return rows.orderBy(F.desc("ecart_pct"), "produit_id").limit(5)


@query(f"""
SELECT r.rule_id, r.type_evenement, coalesce(n, 0) AS declenchements FROM (VALUES (1, 'BAISSE_PRIX'), (2, 'RUPTURE_STOCK'), (3, 'BAISSE_PRIX')) r(rule_id, type_evenement)
LEFT JOIN (SELECT e.type_evenement, count(*) AS n FROM ({FANNED}) f JOIN fx_event e ON e.offre_id = f.offre_id AND e.run = f.run WHERE f.user_id IN (1, 2, 3) AND e.date_detection >= {LAST} - INTERVAL 30 DAY GROUP BY 1) USING (type_evenement)""")
def rule_triggers(t: Tables) -> DataFrame:
    """The tenant's rules with the notifications of their event type to its users in 30 days."""
    users = t.users.where("tenant_id = 1").select("user_id")
    told = fanned(t, t.placed_events.where(since(t, 30))).join(F.broadcast(users), "user_id", "left_semi")
    counts = told.groupBy("type_evenement").agg(F.count("*").alias("declenchements"))
    return t.rules.where("tenant_id = 1").select("rule_id", "type_evenement").join(counts, "type_evenement", "left").na.fill(0, ["declenchements"])


@query(f"""
SELECT categorie, round(avg(own), 6) AS own, round(avg(market), 6) AS market, count(*) AS n FROM (
  SELECT produit_id, min(categorie) AS categorie, CAST(min(CASE WHEN site_id = 0 THEN prix_original END) AS DOUBLE) AS own, avg(CASE WHEN site_id <> 0 THEN CAST(prix_original AS DOUBLE) END) AS market FROM fx_offer WHERE categorie_id IN (1, 2, 3) GROUP BY 1)
WHERE own IS NOT NULL AND market IS NOT NULL GROUP BY categorie ORDER BY own DESC, categorie LIMIT 7""")
def category_averages(t: Tables) -> DataFrame:
    """Mean own and market prices of the seven categories with the highest own ones."""
    rows = site_rows(t).groupBy("categorie").agg(F.round(F.avg("own"), 6).alias("own"), F.round(F.avg("market"), 6).alias("market"), F.count("*").alias("n"))
    return rows.orderBy(F.desc("own"), "categorie").limit(7)


@query(f"SELECT least(100, CAST(floor(n / 5 + 0.5) AS BIGINT)) AS pression, CASE WHEN least(100, floor(n / 5 + 0.5)) > 70 THEN 'haute' WHEN least(100, floor(n / 5 + 0.5)) > 40 THEN 'moyenne' ELSE 'basse' END AS niveau FROM (SELECT count(*) AS n FROM {SCOPED} AND site_id <> 0 AND date_detection >= {LAST} - INTERVAL 7 DAY)")
def pressure_index(t: Tables) -> DataFrame:
    """A fifth of the other sites' events of 7 days, 100 at most, and its level."""
    index = scoped(t).where(since(t, 7)).agg(F.least(F.lit(100).cast("long"), F.floor(F.count("*") / 5 + 0.5).cast("long")).alias("pression"))
    return index.withColumn("niveau", F.when(F.col("pression") > 70, "haute").when(F.col("pression") > 40, "moyenne").otherwise("basse"))


@query(f"""
SELECT n.user_id, n.offre_id, n.run, n.rule_id, CASE e.type_evenement WHEN 'BAISSE_PRIX' THEN slug || ' a baissé un produit' WHEN 'HAUSSE_PRIX' THEN 'Hausse de prix détectée sur ' || slug
  WHEN 'DEBUT_PROMOTION' THEN 'Promotion détectée sur ' || slug WHEN 'RUPTURE_STOCK' THEN 'Rupture détectée sur ' || slug WHEN 'RETOUR_STOCK' THEN 'Retour en stock sur ' || slug ELSE 'Nouveau produit sur ' || slug END AS message
FROM ({FANNED}) n JOIN fx_event e ON e.offre_id = n.offre_id AND e.run = n.run JOIN fx_site s ON s.site_id = e.site_id WHERE e.date_detection >= {LAST} - INTERVAL 30 DAY""")
def alert_inbox(t: Tables) -> DataFrame:
    """The notifications of 30 days with their messages."""
    rows = t.placed_events.where(since(t, 30)).join(t.sites, "site_id").withColumn("message", labels.event_message(F.col("type_evenement"), F.col("slug")))
    return fanned(t, rows).select("user_id", "offre_id", "run", "rule_id", "message")


@query("""
SELECT run_id, CASE WHEN s < 3600 THEN 'il y a ' || CAST(floor(s / 60) AS BIGINT) || ' min' WHEN s < 86400 THEN 'il y a ' || CAST(floor(s / 3600) AS BIGINT) || 'h' WHEN s < 604800 THEN 'il y a ' || CAST(floor(s / 86400) AS BIGINT) || 'j' ELSE day(date_debut) || ' ' || ['janv.', 'févr.', 'mars', 'avr.', 'mai', 'juin', 'juil.', 'août', 'sept.', 'oct.', 'nov.', 'déc.'][month(date_debut)] END AS age,
       CASE WHEN date_fin IS NULL THEN NULL WHEN date_fin + INTERVAL 24 HOUR < now THEN now + INTERVAL 24 HOUR ELSE date_fin + INTERVAL 24 HOUR END AS prochaine
FROM (SELECT *, epoch(now) - epoch(date_debut) AS s FROM (SELECT *, max(date_debut) OVER () + INTERVAL 12 HOUR AS now FROM fx_session))""")
def run_ages(t: Tables) -> DataFrame:
    """How long ago each run began, seen from twelve hours after the last, and when the next one is due."""
    now = t.runs.agg(F.max("date_debut") + F.expr("INTERVAL 12 HOURS")).scalar()
    return t.runs.select("run_id", labels.age(F.col("date_debut"), now).alias("age"), labels.next_run(F.col("date_fin"), now).alias("prochaine"))
