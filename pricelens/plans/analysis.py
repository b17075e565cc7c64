"""Positioning queries: own prices against the market. Site queries are those of tenant 1, brand queries those of tenant 2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import prices
from ..registry import query
from ..tables import Tables

POSITIONS = """
SELECT *, CASE WHEN own <= 0.95 * market THEN 'moins_cher' WHEN own >= 1.05 * market THEN 'plus_cher' ELSE 'dans_moyenne' END AS position FROM (
  SELECT produit_id, min(categorie) AS categorie, CAST(min(CASE WHEN {own} THEN prix_original END) AS DOUBLE) AS own, avg(CASE WHEN NOT ({own}) THEN CAST(prix_original AS DOUBLE) END) AS market
  FROM fx_offer WHERE categorie_id IN ({scope}) GROUP BY {key}) WHERE own IS NOT NULL AND market IS NOT NULL"""
SITE = POSITIONS.format(own="site_id = 0", scope="1, 2, 3", key="produit_id")
BRAND = POSITIONS.replace("produit_id, min(categorie) AS categorie", "groupe_id, min(categorie) AS categorie").format(own="lower(marque) = lower('Brand#1')", scope="1, 2, 3, 4, 5, 6", key="groupe_id")
#: A category is at risk when more than this share of its products, in percent, are dearer than the market.
RISK = 25


def position(own: Column, market: Column) -> Column:
    """Bounds are inclusive, in double."""
    return F.when(own <= S.CHEAPER * market, "moins_cher").when(own >= S.DEARER * market, "plus_cher").otherwise("dans_moyenne")


def positioned(offers: DataFrame, own: Column, keys: list) -> DataFrame:
    """Lowest own price against the mean of the other offers' prices, for each of keys that has both."""
    price = F.col("prix_original").cast("double")
    rows = offers.groupBy(*keys).agg(F.min(F.when(own, price)).alias("own"), F.avg(F.when(~own, price)).alias("market"))
    return rows.where("own is not null and market is not null").withColumn("position", position(F.col("own"), F.col("market")))


def site_rows(t: Tables) -> DataFrame:
    rows = positioned(t.placed.where(t.scope(1)), F.col("site_id") == t.tenant(1)[3], ["produit_id", "categorie_id"])
    return rows.join(F.broadcast(t.categories), "categorie_id")  # a row a category


@query(f"SELECT produit_id, categorie, own, round(market, 6) AS market, position FROM ({SITE})")
def positioning_site(t: Tables) -> DataFrame:
    """Each product's own price against the mean of the other sites' offers."""
    return site_rows(t).select("produit_id", "categorie", "own", F.round("market", 6).alias("market"), "position")


@query(f"SELECT groupe_id, categorie, own, round(market, 6) AS market, position FROM ({BRAND})")
def positioning_brand(t: Tables) -> DataFrame:
    """Each generic product's lowest price of the own brand, in any case, against the mean of the other brands'."""
    own = F.lower("marque") == t.tenant(2)[4].lower()
    rows = positioned(t.offers.where(t.scope(2) & F.col("marque").isNotNull()), own, ["groupe_id", "categorie"])
    return rows.select("groupe_id", "categorie", "own", F.round("market", 6).alias("market"), "position")


@query(f"""
SELECT position, count(own) AS n, CASE WHEN sum(count(own)) OVER () > 0 THEN round(100.0 * count(own) / sum(count(own)) OVER (), 1) ELSE 0.0 END AS pct
FROM (SELECT unnest(['moins_cher', 'dans_moyenne', 'plus_cher']) AS position) LEFT JOIN ({SITE}) USING (position) GROUP BY position""")
def positioning_summary(t: Tables) -> DataFrame:
    """Products of each of the three positions, and their share; an empty position has zeros."""
    kinds = t.spark.createDataFrame([("moins_cher",), ("dans_moyenne",), ("plus_cher",)], "position string")
    counts = kinds.join(site_rows(t).groupBy("position").agg(F.count("*").alias("n")), "position", "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy())  # three rows
    return counts.select("position", "n", F.coalesce(F.round(F.try_divide(100.0 * F.col("n"), total), 1), F.lit(0.0)).alias("pct"))


BY_CATEGORY = f"""
SELECT categorie, count(*) AS total, count(*) FILTER (position = 'plus_cher') AS plus_cher, count(*) FILTER (position = 'moins_cher') AS moins_cher,
       count(*) FILTER (position = 'dans_moyenne') AS dans_moyenne, round(100.0 * count(*) FILTER (position = 'plus_cher') / count(*), 1) AS pct_plus_cher FROM ({SITE}) GROUP BY categorie"""


def by_category(t: Tables) -> DataFrame:
    count = lambda p: F.count_if(F.col("position") == p).alias(p)
    rows = site_rows(t).groupBy("categorie").agg(F.count("*").alias("total"), count("plus_cher"), count("moins_cher"), count("dans_moyenne"))
    return rows.withColumn("pct_plus_cher", F.round(100.0 * F.col("plus_cher") / F.col("total"), 1).cast("double"))


@query(BY_CATEGORY)
def positioning_categories(t: Tables) -> DataFrame:
    """Positions by category."""
    return by_category(t)


def at_risk(rows: DataFrame, bound: float = RISK, most: int = 3) -> DataFrame:
    """Of categories with pct_plus_cher and total, those over the bound with the greatest share."""
    return rows.where(F.col("pct_plus_cher") > bound).orderBy(F.desc("pct_plus_cher"), "categorie").limit(most).select("categorie", "pct_plus_cher", F.col("total").alias("nb_produits"))


@query(f"SELECT categorie, pct_plus_cher, total AS nb_produits FROM ({BY_CATEGORY}) WHERE pct_plus_cher > {RISK} ORDER BY pct_plus_cher DESC, categorie LIMIT 3")
def risk_categories(t: Tables) -> DataFrame:
    """The three categories with the greatest share of dearer products, over the bound."""
    return at_risk(by_category(t))


@query(f"SELECT categorie, pct_plus_cher, total AS nb_produits FROM ({BY_CATEGORY}) WHERE pct_plus_cher > 1 ORDER BY pct_plus_cher DESC, categorie LIMIT 3")
def watched_categories(t: Tables) -> DataFrame:
    """The same over a bound of 1 percent."""
    return at_risk(by_category(t), 1)


@query("""
SELECT produit_id, slug, CAST(prix_original AS DOUBLE) AS prix FROM (
  SELECT *, row_number() OVER (PARTITION BY produit_id ORDER BY prix_original, slug) AS n FROM fx_offer JOIN fx_site USING (site_id) WHERE categorie_id IN (1, 2, 3) AND site_id <> 0) WHERE n = 1""")
def cheapest_competitor(t: Tables) -> DataFrame:
    """The other site with the lowest price of each product in scope; of equal ones the first by name."""
    rows = t.placed.where(t.scope(1) & (F.col("site_id") != t.tenant(1)[3]) & F.col("prix_original").isNotNull()).join(t.sites, "site_id")
    best = rows.groupBy("produit_id").agg(F.min(F.struct("prix_original", "slug")).alias("_b"))
    return best.select("produit_id", F.col("_b.slug").alias("slug"), F.col("_b.prix_original").cast("double").alias("prix"))


@query("""
WITH scope AS (SELECT DISTINCT produit_id FROM fx_offer WHERE categorie_id IN (1, 2, 3)),
own AS (SELECT produit_id, min(prix_original) AS p FROM fx_offer JOIN scope USING (produit_id) WHERE site_id = 0 GROUP BY 1),
comp AS (SELECT site_id, produit_id, min(prix_original) AS p FROM fx_offer JOIN scope USING (produit_id) WHERE site_id <> 0 GROUP BY 1, 2),
cheaper AS (SELECT comp.site_id, count(*) AS n FROM comp JOIN own ON own.produit_id = comp.produit_id AND comp.p < own.p GROUP BY 1),
promo AS (SELECT site_id, count(*) AS n FROM fx_offer JOIN scope USING (produit_id) WHERE en_promo AND site_id <> 0 GROUP BY 1)
SELECT s.site_id, slug, coalesce(c.n, 0) AS moins_chers, coalesce(p.n, 0) AS promos,
       least(CAST(round_even(coalesce(c.n, 0) / greatest((SELECT count(*) FROM scope), 1) * 10, 0) AS BIGINT), 10) AS intensite
FROM fx_site s LEFT JOIN cheaper c USING (site_id) LEFT JOIN promo p USING (site_id) WHERE s.site_id <> 0""")
def competitors(t: Tables) -> DataFrame:
    """Every other site, with the products in scope that it sells below the lowest own price, its promotions in
    scope, and the former's share of all products in scope as an intensity of 0 to 10."""
    mine = t.tenant(1)[3]
    scoped = t.placed.where(t.scope(1))
    # A row a product: the lowest price and the promotions of each site (as many as there are sites).
    cells = scoped.groupBy("produit_id", "site_id").agg(F.min("prix_original").alias("low"), F.count_if("en_promo").alias("promos"))
    own = F.min(F.when(F.col("site_id") == mine, F.col("low")))
    products = cells.groupBy("produit_id").agg(own.alias("_own"), F.collect_list(F.struct("site_id", "low", "promos")).alias("_sites"))
    each = products.select("_own", F.explode("_sites").alias("_s"))
    rows = each.groupBy("_s.site_id").agg(F.count_if(F.col("_s.low") < F.col("_own")).alias("moins_chers"), F.sum("_s.promos").alias("promos"))
    total = F.greatest(scoped.agg(F.countDistinct("produit_id")).scalar(), F.lit(1))
    out = t.sites.where(F.col("site_id") != mine).join(rows, "site_id", "left").na.fill(0, ["moins_chers", "promos"])
    return out.select("site_id", "slug", "moins_chers", "promos", prices.intensity(F.col("moins_chers"), total).cast("long").alias("intensite"))


@query(f"""
SELECT produit_id, jour, CASE WHEN own <= 0.95 * comp THEN 1 WHEN own >= 1.05 * comp THEN -1 WHEN own IS NOT NULL AND comp IS NOT NULL THEN 0 END AS score FROM (
  SELECT produit_id, CAST(date_debut AS DATE) AS jour, avg(CASE WHEN site_id = 0 THEN CAST(prix_original AS DOUBLE) END) AS own, avg(CASE WHEN site_id <> 0 THEN CAST(prix_original AS DOUBLE) END) AS comp
  FROM fx_snapshot JOIN fx_product USING (produit_id) WHERE categorie_id IN (1, 2, 3) AND date_debut >= (SELECT max(observed_at) FROM fx_obs) - INTERVAL 30 DAY GROUP BY 1, 2)""")
def position_history(t: Tables) -> DataFrame:
    """For each product in scope and day of the last 30 with a new price: 1 if the mean own one is cheaper, -1 if it is
    dearer, 0 between, null where one side has none."""
    price, own = F.col("prix_original").cast("double"), F.col("site_id") == t.tenant(1)[3]
    recent = t.with_offer(t.snapshots).where(t.scope(1) & t.months(30) & (F.col("date_debut") >= t.as_of - F.expr("INTERVAL 30 DAYS")))
    rows = recent.groupBy("produit_id", F.to_date("date_debut").alias("jour")).agg(F.avg(F.when(own, price)).alias("own"), F.avg(F.when(~own, price)).alias("comp"))
    where = position(F.col("own"), F.col("comp"))
    score = F.when(F.col("own").isNotNull() & F.col("comp").isNotNull(), F.when(where == "moins_cher", 1).when(where == "plus_cher", -1).otherwise(0))
    return rows.select("produit_id", "jour", score.alias("score"))
