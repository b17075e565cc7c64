"""Catalogue queries: categories, brands, products, offers and their histories. Scoped ones are those of tenant 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import events, intervals
from ..registry import query
from ..tables import Tables

#: Days of history.
SPAN = 30


def double(c: str):
    return F.col(c).cast("double").alias(c)


@query("SELECT offre_id, run, date_debut, date_fin, nb_observations, CAST(prix_original AS DOUBLE) AS prix_original, CAST(prix_en_promotion AS DOUBLE) AS prix_en_promotion, stock_status FROM fx_snapshot")
def snapshot_compaction(t: Tables) -> DataFrame:
    """All observations as validity intervals."""
    return t.compacted.select("offre_id", "run", "date_debut", "date_fin", "nb_observations", double("prix_original"), double("prix_en_promotion"), "stock_status")


@query("SELECT offre_id, run, type_evenement, CAST(valeur_avant AS DOUBLE) AS valeur_avant, CAST(valeur_apres AS DOUBLE) AS valeur_apres, date_detection FROM fx_event")
def event_detection(t: Tables) -> DataFrame:
    """The event of each interval that has one."""
    return events.only(t.told, "offre_id").select("offre_id", "run", "type_evenement", double("valeur_avant"), double("valeur_apres"), "date_detection")


@query("SELECT categorie_id, categorie, count(DISTINCT produit_id) AS nb_produits FROM fx_offer WHERE categorie_id IN (1, 2, 3) GROUP BY ALL")
def product_categories(t: Tables) -> DataFrame:
    """Categories in scope and their products on sale."""
    counts = t.placed.where(t.scope(1)).groupBy("categorie_id").agg(F.countDistinct("produit_id").alias("nb_produits"))
    return counts.join(F.broadcast(t.categories), "categorie_id").select("categorie_id", "categorie", "nb_produits")


@query("SELECT marque, count(DISTINCT produit_id) AS nb_produits FROM fx_offer WHERE categorie_id IN (1, 2, 3) AND marque ILIKE '%#1%' GROUP BY marque ORDER BY nb_produits DESC, marque LIMIT 50")
def product_brands(t: Tables, q: str = "#1") -> DataFrame:
    """The 50 brands in scope with the most products, among those whose name has a text."""
    rows = t.offers.where(t.scope(1) & F.col("marque").ilike(f"%{q}%")).groupBy("marque").agg(F.countDistinct("produit_id").alias("nb_produits"))
    return rows.orderBy(F.desc("nb_produits"), "marque").limit(50)


LIST = """
SELECT produit_id, nom, marque, categorie, count(DISTINCT site_id) AS nb_sites, CAST(min(prix_original) AS DOUBLE) AS prix_min, CAST(max(prix_original) AS DOUBLE) AS prix_max,
       round(avg(CAST(prix_original AS DOUBLE)), 6) AS prix_moyen, bool_or(en_promo) AS has_promo, array_to_string(list_sort(list(DISTINCT slug)), ',') AS sites, max(date_debut) AS derniere
FROM fx_offer JOIN fx_site USING (site_id) WHERE categorie_id IN (1, 2, 3) GROUP BY ALL"""


def listed(t: Tables, categorie_id: int | None = None) -> DataFrame:
    rows = t.placed.where(t.scope(1)).join(t.sites, "site_id")
    if categorie_id:
        rows = rows.where(F.col("categorie_id") == categorie_id)
    # Names and brands come to the products, not to their offers.
    told = rows.groupBy("produit_id").agg(
        F.countDistinct("site_id").alias("nb_sites"),
        F.min("prix_original").cast("double").alias("prix_min"),
        F.max("prix_original").cast("double").alias("prix_max"),
        F.round(F.avg(F.col("prix_original").cast("double")), 6).alias("prix_moyen"),
        F.bool_or("en_promo").alias("has_promo"),
        F.array_join(F.array_sort(F.collect_set("slug")), ",").alias("sites"),
        F.max("date_debut").alias("derniere"),
    )
    names = t.products.where(t.scope(1)).select("produit_id", "nom", "marque", "categorie")
    return names.join(told, "produit_id").select("produit_id", "nom", "marque", "categorie", *told.columns[1:])


@query(LIST)
def product_list(t: Tables) -> DataFrame:
    """Every product in scope with its sites, price range and promotion flag; prices are the current original ones."""
    return listed(t)


@query(f"SELECT * FROM ({LIST}) WHERE nb_sites >= 2 AND prix_max >= 910 AND prix_min <= 1000 ORDER BY prix_max - prix_min DESC, produit_id LIMIT 20 OFFSET 20")
def product_page(t: Tables) -> DataFrame:
    """The second page of products by spread, on two sites at least, whose price range overlaps another."""
    rows = listed(t).where((F.col("nb_sites") >= 2) & (F.col("prix_max") >= 910) & (F.col("prix_min") <= 1000))
    return rows.orderBy((F.col("prix_max") - F.col("prix_min")).desc_nulls_last(), "produit_id").offset(20).limit(20)


@query("""
SELECT produit_id, slug, CAST(prix_original AS DOUBLE) AS prix, stock_status, CAST(prix_original - low AS DOUBLE) AS ecart,
       round(CASE WHEN low > 0 THEN CAST(prix_original - low AS DOUBLE) / CAST(low AS DOUBLE) * 100 END, 2) AS ecart_pct, CAST(prix_original AS DOUBLE) <= CAST(low AS DOUBLE) * 1.001 AS meilleur_prix
FROM (SELECT o.*, min(prix_original) OVER (PARTITION BY produit_id) AS low FROM fx_offer o) JOIN fx_site USING (site_id)""")
def product_comparison(t: Tables) -> DataFrame:
    """Each product's price on each site against its lowest."""
    low = t.current.groupBy("produit_id").agg(F.min("prix_original").alias("low"))
    rows = t.current.join(low, "produit_id").join(t.sites, "site_id")
    price, least = F.col("prix_original").cast("double"), F.col("low").cast("double")
    gap = (F.col("prix_original") - F.col("low")).cast("double")
    return rows.select("produit_id", "slug", price.alias("prix"), "stock_status", gap.alias("ecart"), F.round(F.when(least > 0, gap / least * 100), 2).alias("ecart_pct"), (price <= least * S.BEST_PRICE).alias("meilleur_prix"))


@query(f"""
WITH day AS (SELECT CAST(unnest(generate_series(m - INTERVAL {SPAN} DAY, m, INTERVAL 1 DAY)) AS DATE) AS jour FROM (SELECT max(observed_at) AS m FROM fx_obs)),
active AS (SELECT * FROM (
  SELECT s.*, d.jour, row_number() OVER (PARTITION BY offre_id, d.jour ORDER BY date_debut DESC, run DESC) AS n
  FROM fx_snapshot s JOIN day d ON CAST(date_debut AS DATE) <= d.jour AND (date_fin IS NULL OR CAST(date_fin AS DATE) >= d.jour)) WHERE n = 1)
SELECT o.offre_id, day.jour, CAST(a.prix_original AS DOUBLE) AS prix,
       CASE WHEN a.prix_original IS NOT NULL THEN a.prix_en_promotion IS NOT NULL AND a.prix_en_promotion < a.prix_original END AS en_promo
FROM (SELECT DISTINCT offre_id FROM fx_snapshot JOIN fx_product USING (produit_id) WHERE categorie_id IN (1, 2, 3)) o CROSS JOIN day LEFT JOIN active a ON a.offre_id = o.offre_id AND a.jour = day.jour""")
def price_history(t: Tables) -> DataFrame:
    """The price of each offer in scope, and whether it was on promotion, on each of the last days; null on days without one."""
    last = F.to_date(t.as_of)
    scoped = t.snapshots.where(t.scope(1))
    days = intervals.calendar_as_of(scoped.select("offre_id", "run", "date_debut", "date_fin", "prix_original", "prix_en_promotion"), F.date_sub(last, SPAN), last)
    promo = F.coalesce(F.col("prix_en_promotion") < F.col("prix_original"), F.lit(False))
    return days.select("offre_id", "jour", double("prix_original").alias("prix"), F.when(F.col("prix_original").isNotNull(), promo).alias("en_promo"))


@query("SELECT c.categorie_id, c.categorie, count(DISTINCT produit_id) AS nb_produits FROM fx_category c LEFT JOIN fx_offer o ON o.categorie_id = c.categorie_id WHERE c.categorie_id NOT IN (1, 2, 3) GROUP BY ALL")
def available_categories(t: Tables) -> DataFrame:
    """Categories that are not in scope and their products on sale, 0 for those without any."""
    scope = t.scopes.where("tenant_id = 1")
    counts = t.placed.groupBy("categorie_id").agg(F.countDistinct("produit_id").alias("nb_produits"))
    return t.categories.join(scope, "categorie_id", "left_anti").join(counts, "categorie_id", "left").na.fill(0, ["nb_produits"])


@query("SELECT offre_id, nom, slug, CAST(prix_original AS DOUBLE) AS prix, stock_status FROM fx_offer JOIN fx_site USING (site_id) WHERE categorie_id IN (1, 2, 3) AND (nom ILIKE '%1%' OR marque ILIKE '%#2%') AND en_promo")
def offers_list(t: Tables) -> DataFrame:
    """Offers in scope on promotion whose name or brand has a text."""
    rows = t.offers.where(t.scope(1) & F.col("en_promo") & (F.col("nom").ilike("%1%") | F.col("marque").ilike("%#2%")))
    return rows.join(t.sites, "site_id").select("offre_id", "nom", "slug", double("prix_original").alias("prix"), "stock_status")


@query("""
SELECT offre_id, count(DISTINCT prix_original) AS niveaux, CAST(sum(nb_observations) AS BIGINT) AS observations,
       CAST(sum(CASE WHEN prix_en_promotion IS NOT NULL THEN greatest(0, floor(epoch(coalesce(date_fin, m) - date_debut) / 86400)) ELSE 0 END) AS BIGINT) AS jours_promo,
       CAST(sum(CASE WHEN stock_status = 'RUPTURE' THEN greatest(0, floor(epoch(coalesce(date_fin, m) - date_debut) / 86400)) ELSE 0 END) AS BIGINT) AS jours_rupture,
       round(avg(CASE WHEN date_debut >= m - INTERVAL 90 DAY THEN CAST(prix_original AS DOUBLE) END), 6) AS moyenne_90j
FROM fx_snapshot, (SELECT max(observed_at) AS m FROM fx_obs) GROUP BY offre_id""")
def offer_lifetime(t: Tables) -> DataFrame:
    """Price levels, days on promotion and out of stock, and the mean price of 90 days, of each offer."""
    days = intervals.whole_days(F.col("date_debut"), F.coalesce("date_fin", t.as_of))
    return t.snapshots.groupBy("offre_id").agg(
        F.countDistinct("prix_original").alias("niveaux"),
        F.sum("nb_observations").alias("observations"),
        F.sum(F.when(F.col("prix_en_promotion").isNotNull(), days).otherwise(0)).alias("jours_promo"),
        F.sum(F.when(F.col("stock_status").isin(*S.STRICT_OUT), days).otherwise(0)).alias("jours_rupture"),
        F.round(F.avg(F.when(F.col("date_debut") >= t.as_of - F.expr("INTERVAL 90 DAYS"), F.col("prix_original").cast("double"))), 6).alias("moyenne_90j"),
    )


@query("""
SELECT o.offre_id, round(CAST(o.prix_original AS DOUBLE) - CAST(p.prix_original AS DOUBLE), 3) AS delta,
       round((CAST(o.prix_original AS DOUBLE) - CAST(p.prix_original AS DOUBLE)) / nullif(CAST(p.prix_original AS DOUBLE), 0) * 100, 1) AS delta_pct
FROM fx_offer o JOIN (SELECT *, row_number() OVER (PARTITION BY offre_id ORDER BY date_fin DESC, run DESC) AS n FROM fx_snapshot WHERE date_fin IS NOT NULL) p ON p.offre_id = o.offre_id AND n = 1""")
def offer_delta(t: Tables) -> DataFrame:
    """The current price of each offer against that of its interval before."""
    before = intervals.previous_closed(t.snapshots.select("offre_id", "run", "date_fin", "prix_original")).select("offre_id", F.col("prix_original").alias("_before"))
    change, share = events.price_delta(F.col("prix_original"), F.col("_before"))
    return t.current.join(before, "offre_id").select("offre_id", change.alias("delta"), share.alias("delta_pct"))


@query("""
SELECT offre_id, run, date_debut, date_fin, CAST(prix_original AS DOUBLE) AS prix FROM fx_snapshot, (SELECT max(observed_at) AS m FROM fx_obs)
WHERE date_debut < m AND (date_fin IS NULL OR date_fin >= m - INTERVAL 90 DAY)""")
def offer_history(t: Tables) -> DataFrame:
    """Intervals that touch the last 90 days."""
    return intervals.overlapping(t.snapshots, t.as_of - F.expr("INTERVAL 90 DAYS"), t.as_of).select("offre_id", "run", "date_debut", "date_fin", double("prix_original").alias("prix"))


#: Orders of the product list by name; another name gives that of product names.
SORTS = {"prix_asc": (F.asc_nulls_last, "prix_min"), "ecart_desc": (F.desc_nulls_last, "_spread"), "recent": (F.desc_nulls_last, "derniere")}


def products_page(t: Tables, q: str | None = None, brands: tuple[str, ...] = (), categorie_id: int | None = None, en_promo: bool = False, min_sites: int | None = None, low: float | None = None, high: float | None = None, sort: str = "", page: int = 1, limit: int = 20) -> DataFrame:
    """A page of products in scope under any of the filters, with the total and the number of pages. Brands are taken in any case; low and high ask that the range of prices overlaps theirs; of equals the smaller number."""
    rows = listed(t, categorie_id).withColumn("_spread", F.col("prix_max") - F.col("prix_min"))
    if q:
        rows = rows.where(F.col("nom").ilike(f"%{q}%") | F.col("marque").ilike(f"%{q}%"))
    if brands:
        rows = rows.where(F.lower("marque").isin(*(b.lower() for b in brands)))
    if en_promo:
        rows = rows.where("has_promo")
    if min_sites:
        rows = rows.where(F.col("nb_sites") >= min_sites)
    if low is not None:
        rows = rows.where(F.col("prix_max") >= low)
    if high is not None:
        rows = rows.where(F.col("prix_min") <= high)
    order, column = SORTS.get(sort, (F.asc_nulls_last, "nom"))
    total = rows.agg(F.count("*")).scalar()
    out = rows.orderBy(order(column), "produit_id").offset((page - 1) * limit).limit(limit)
    return out.drop("_spread").withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / limit))


def page_sql(rows: str, where: str, order: str, page: int, limit: int) -> str:
    return f"SELECT *, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / {limit}) AS BIGINT) AS pages FROM ({rows}) WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {(page - 1) * limit}"


@query(page_sql(LIST, "lower(marque) IN ('brand#1', 'brand#2', 'brand#13') AND has_promo AND prix_max >= 905 AND prix_min <= 1050", "prix_min ASC NULLS LAST, produit_id", 1, 20))
def products_by_price(t: Tables) -> DataFrame:
    """Products of three brands on promotion within a range of prices, the cheapest first."""
    return products_page(t, brands=("BRAND#1", "brand#2", "Brand#13"), en_promo=True, low=905, high=1050, sort="prix_asc")


@query(page_sql(LIST.replace("IN (1, 2, 3)", "IN (1, 2, 3) AND categorie_id = 2"), "(nom ILIKE '%a%' OR marque ILIKE '%a%') AND nb_sites >= 2", "derniere DESC NULLS LAST, produit_id", 2, 10))
def products_recent(t: Tables) -> DataFrame:
    """The second page of a category's products whose name or brand has a text, those seen last first."""
    return products_page(t, q="a", categorie_id=2, min_sites=2, sort="recent", page=2, limit=10)


@query(page_sql(LIST, "true", "nom ASC NULLS LAST, produit_id", 3, 20))
def products_by_name(t: Tables) -> DataFrame:
    """The third page of all products, by name."""
    return products_page(t, page=3)


def all_offers(t: Tables) -> DataFrame:
    """Every offer that was ever seen, with its product, and the site of its run and its open interval where there are any: offers of runs after the 30th have no run here, every 17th no open interval."""
    seen = t.with_offer(t.current.select("offre_id")).join(t.products, "produit_id").withColumn("run_id", 1 + F.col("offre_id") % 40).drop("site_id")
    runs = t.runs.where("run_id <= 30").select("run_id", F.col("site_id").alias("run_site"))
    sites = t.sites.select(F.col("site_id").alias("run_site"), "slug")
    now = t.snapshots.where("date_fin is null and offre_id % 17 <> 0").select("offre_id", "prix_original", "prix_en_promotion", "stock_status")
    return seen.join(runs, "run_id", "left").join(sites, "run_site", "left").join(now, "offre_id", "left")


def offers_page(t: Tables, q: str | None = None, marque: str | None = None, categorie_id: int | None = None, site_id: int | None = None, en_promo: bool = False, en_stock: bool = False, sort: str = "nom", order: str = "asc", page: int = 1, limit: int = 50) -> DataFrame:
    """A page of offers in scope under any of the filters, by name or current price, nulls last in either direction; with the total and the number of pages."""
    rows = all_offers(t).where(t.scope(1))
    if q:
        rows = rows.where(F.col("nom").ilike(f"%{q}%") | F.col("marque").ilike(f"%{q}%"))
    if marque:
        rows = rows.where(F.col("marque") == marque)
    if categorie_id:
        rows = rows.where(F.col("categorie_id") == categorie_id)
    if site_id is not None:
        rows = rows.where(F.col("run_site") == site_id)
    if en_promo:
        rows = rows.where(F.col("prix_en_promotion").isNotNull())
    if en_stock:
        rows = rows.where(F.col("stock_status") == "IN_STOCK")
    column = "prix_original" if sort == "prix" else "nom"
    total = rows.agg(F.count("*")).scalar()
    out = rows.orderBy(F.desc_nulls_last(column) if order == "desc" else F.asc_nulls_last(column), "offre_id").offset((page - 1) * limit).limit(limit)
    return out.select("offre_id", "nom", "marque", "slug", double("prix_original").alias("prix"), "stock_status", total.alias("total"), F.ceil(total / limit).alias("pages"))


ALL_OFFERS = """
SELECT o.offre_id, o.nom, o.marque, slug, CAST(s.prix_original AS DOUBLE) AS prix, s.stock_status, s.prix_en_promotion AS _promo, r.site_id AS _site
FROM fx_offer_run o LEFT JOIN (SELECT run_id, site_id FROM fx_session WHERE run_id <= 30) r USING (run_id) LEFT JOIN fx_site w ON w.site_id = r.site_id
LEFT JOIN (SELECT * FROM fx_snapshot WHERE date_fin IS NULL AND offre_id % 17 <> 0) s ON s.offre_id = o.offre_id WHERE o.categorie_id IN (1, 2, 3)"""


@query(f"SELECT * EXCLUDE (_promo, _site) FROM ({page_sql(ALL_OFFERS, 'true', 'prix DESC NULLS LAST, offre_id', 1, 50)})")
def offers_by_price(t: Tables) -> DataFrame:
    """The dearest offers, those without a run or a current price with them."""
    return offers_page(t, sort="prix", order="desc")


@query(f"SELECT * EXCLUDE (_promo, _site) FROM ({page_sql(ALL_OFFERS, 'prix IS NULL', 'nom ASC NULLS LAST, offre_id', 1, 1000)})")
def offers_unpriced(t: Tables) -> DataFrame:
    """Offers without an open interval: the left join keeps them, without price and stock."""
    rows = all_offers(t).where(t.scope(1) & F.col("prix_original").isNull())
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy("nom", "offre_id").limit(1000).select("offre_id", "nom", "marque", "slug", double("prix_original").alias("prix"), "stock_status", total.alias("total"), F.ceil(total / 1000).alias("pages"))


@query(f"""SELECT * EXCLUDE (_promo, _site) FROM ({page_sql(ALL_OFFERS, "(nom ILIKE '%e%' OR marque ILIKE '%e%') AND _site = 2 AND _promo IS NOT NULL AND stock_status = 'IN_STOCK'", 'nom ASC NULLS LAST, offre_id', 1, 20)})""")
def offers_filtered(t: Tables) -> DataFrame:
    """Offers of one site on promotion and in stock whose name or brand has a text, by name."""
    return offers_page(t, q="e", site_id=2, en_promo=True, en_stock=True, limit=20)
