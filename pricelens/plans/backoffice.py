"""Back-office queries: runs, platform figures and the dashboards of a run's listing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..tables import TENANTS, USERS, Tables

LATEST = "(SELECT max(run_id) FROM fx_session)"
PAGES = f"fx_stat WHERE run_id = {LATEST}"


def latest(t: Tables) -> Column:
    """The number of the last run, a one-row subquery of the plan."""
    return t.runs.agg(F.max("run_id")).scalar()


def pages(t: Tables) -> DataFrame:
    """The listing pages of the last run."""
    return t.page_stats.where(F.col("run_id") == latest(t))


def with_run(t: Tables) -> DataFrame:
    """Current offers with the run that saw them."""
    return t.placed.withColumn("run_id", 1 + F.col("offre_id") % 40)


def metrics(rows: DataFrame, *named: tuple[str, Column]) -> DataFrame:
    """A row for each named aggregate of rows."""
    one = rows.agg(*(value.cast("long").alias(f"m{k}") for k, (_, value) in enumerate(named)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), F.col(f"m{k}").alias("value")) for k, (name, _) in enumerate(named)))).alias("_m")).select("_m.*")


@query(f"""
SELECT 'Catégories scrapées' AS metric, count(DISTINCT category_url) AS value FROM {PAGES} UNION ALL SELECT 'Pages totales', count(*) FROM {PAGES}
UNION ALL SELECT 'Produits trouvés', CAST(coalesce(sum(products_found), 0) AS BIGINT) FROM {PAGES} UNION ALL SELECT 'Catégories vides (0 produit)', count(*) FROM {PAGES} AND products_found = 0""")
def run_metrics(t: Tables) -> DataFrame:
    """Categories, pages, products and empty pages of the last run."""
    return metrics(pages(t), ("Catégories scrapées", F.countDistinct("category_url")), ("Pages totales", F.count("*")), ("Produits trouvés", F.coalesce(F.sum("products_found"), F.lit(0))), ("Catégories vides (0 produit)", F.count_if(F.col("products_found") == 0)))


@query(f"""
SELECT found, kept, greatest(0, found - kept) AS doublons, CASE WHEN found = 0 THEN 0.0 ELSE round(greatest(0, found - kept) * 100.0 / found, 1) END AS taux FROM (
  SELECT CAST(coalesce((SELECT sum(products_found) FROM {PAGES}), 0) AS BIGINT) AS found, (SELECT count(*) FROM fx_offer_run WHERE run_id = {LATEST}) AS kept)""")
def duplicate_rate(t: Tables) -> DataFrame:
    """Products found by the last run, offers kept, and the share that were duplicates."""
    found = pages(t).agg(F.coalesce(F.sum("products_found"), F.lit(0)).alias("found"))
    kept = with_run(t).where(F.col("run_id") == latest(t)).agg(F.count("*")).scalar()
    rows = found.withColumn("kept", kept).withColumn("doublons", F.greatest(F.lit(0).cast("long"), F.col("found") - F.col("kept")))
    return rows.withColumn("taux", F.coalesce(F.round(F.try_divide(F.col("doublons") * 100.0, F.col("found")), 1), F.lit(0.0)))


@query(f"SELECT site, category_url, page_number, duration_ms, scraped_at FROM {PAGES} AND products_found = 0")
def empty_pages(t: Tables) -> DataFrame:
    """Pages of the last run without products."""
    return pages(t).where("products_found = 0").select("site", "category_url", "page_number", "duration_ms", "scraped_at").orderBy("site", "category_url", "page_number")


@query(f"SELECT category_url, CAST(sum(products_found) AS BIGINT) AS total_products FROM {PAGES} GROUP BY category_url ORDER BY total_products DESC, category_url LIMIT 30")
def top_categories(t: Tables) -> DataFrame:
    """The 30 categories with the most products of the last run."""
    return pages(t).groupBy("category_url").agg(F.sum("products_found").alias("total_products")).orderBy(F.desc("total_products"), "category_url").limit(30)


@query(f"SELECT site, category_url, max(page_number) AS pages_scrapees, CAST(sum(products_found) AS BIGINT) AS total_produits FROM {PAGES} GROUP BY ALL HAVING max(page_number) > 1")
def paged_categories(t: Tables) -> DataFrame:
    """Categories of several pages."""
    rows = pages(t).groupBy("site", "category_url").agg(F.max("page_number").alias("pages_scrapees"), F.sum("products_found").alias("total_produits"))
    return rows.where("pages_scrapees > 1").orderBy(F.desc("pages_scrapees"))


@query(f"""
SELECT site, category_url, max(page_number) AS derniere_page, CAST(sum(products_found) AS BIGINT) AS total_produits FROM fx_stat s WHERE run_id = {LATEST} AND has_next_page = 1
GROUP BY site, category_url HAVING max(page_number) = (SELECT max(page_number) FROM fx_stat o WHERE o.run_id = {LATEST} AND o.category_url = s.category_url)
ORDER BY derniere_page DESC, site, category_url LIMIT 20""")
def truncated_categories(t: Tables) -> DataFrame:
    """Categories whose last page still has a next one."""
    rows = pages(t)
    going = rows.where("has_next_page = 1").groupBy("site", "category_url").agg(F.max("page_number").alias("derniere_page"), F.sum("products_found").alias("total_produits"))
    last = rows.groupBy("category_url").agg(F.max("page_number").alias("_last"))
    return going.join(last, "category_url").where("derniere_page = _last").drop("_last").orderBy(F.desc("derniere_page"), "site", "category_url").limit(20)


@query(f"SELECT duration_ms FROM {PAGES} AND duration_ms IS NOT NULL")
def page_durations(t: Tables) -> DataFrame:
    """What a histogram of durations is made of."""
    return pages(t).where("duration_ms is not null").select("duration_ms")


@query(f"SELECT scraped_at AS time, CAST(sum(products_found) OVER (ORDER BY scraped_at) AS BIGINT) AS cumulative_products FROM {PAGES}")
def cumulative_products(t: Tables) -> DataFrame:
    """Products found up to each moment of the last run; moments alike share the sum.

    Sums of the moments are taken first, so that the window over one run sees a row for each moment.
    """
    rows = pages(t)
    moments = rows.groupBy("scraped_at").agg(F.sum("products_found").alias("_n"))
    upto = moments.withColumn("cumulative_products", F.sum("_n").over(Window.orderBy("scraped_at"))).drop("_n")
    return rows.select("scraped_at").join(upto, "scraped_at").select(F.col("scraped_at").alias("time"), "cumulative_products")


@query(f"SELECT site_id, count(*) AS stale_count FROM fx_offer_run WHERE run_id <> {LATEST} GROUP BY site_id")
def stale_offers(t: Tables) -> DataFrame:
    """Offers that the last run did not see, by site."""
    return with_run(t).where(F.col("run_id") != latest(t)).groupBy("site_id").agg(F.count("*").alias("stale_count"))


@query("SELECT CAST(r.run_id AS VARCHAR) AS session, statut, CAST(coalesce(sum(products_found), 0) AS BIGINT) AS total_produits FROM fx_session r LEFT JOIN fx_stat s USING (run_id) GROUP BY r.run_id, statut ORDER BY r.run_id DESC LIMIT 10")
def last_sessions(t: Tables) -> DataFrame:
    """The last ten runs and their products."""
    found = t.page_stats.groupBy("run_id").agg(F.sum("products_found").alias("_n"))
    last = t.runs.orderBy(F.desc("run_id")).limit(10)
    return last.join(found, "run_id", "left").select(F.col("run_id").cast("string").alias("session"), "statut", F.coalesce("_n", F.lit(0).cast("long")).alias("total_produits"))


@query("""
SELECT r.site_id, slug, count(*) AS total_runs, count(*) FILTER (statut = 'TERMINE') AS successful, count(*) FILTER (statut = 'ECHOUE') AS failed, round(coalesce(avg(n), 0), 6) AS avg_offres_per_run, max(date_debut) AS last_run_at
FROM fx_session r JOIN fx_site USING (site_id) LEFT JOIN (SELECT run_id, count(*) AS n FROM fx_offer_run GROUP BY 1) o USING (run_id) GROUP BY r.site_id, slug""")
def site_runs(t: Tables) -> DataFrame:
    """Runs of each site, how they ended, the mean of their offers (runs without any do not count) and the last one."""
    seen = with_run(t).groupBy("run_id").agg(F.count("*").alias("_n"))
    rows = t.runs.join(t.sites, "site_id").join(seen, "run_id", "left")
    return rows.groupBy("site_id", "slug").agg(
        F.count("*").alias("total_runs"), F.count_if(F.col("statut") == "TERMINE").alias("successful"), F.count_if(F.col("statut") == "ECHOUE").alias("failed"),
        F.round(F.coalesce(F.avg("_n"), F.lit(0.0)), 6).alias("avg_offres_per_run"), F.max("date_debut").alias("last_run_at"),
    )


@query("SELECT run_id, slug, statut, date_debut, date_fin, CAST(epoch(date_fin) - epoch(date_debut) AS BIGINT) AS duree_s FROM fx_session JOIN fx_site USING (site_id) WHERE statut <> 'EN_COURS'")
def run_list(t: Tables) -> DataFrame:
    """Ended runs and their duration in seconds."""
    seconds = F.unix_seconds(F.col("date_fin").cast("timestamp")) - F.unix_seconds(F.col("date_debut").cast("timestamp"))
    return t.runs.where("statut <> 'EN_COURS'").join(t.sites, "site_id").select("run_id", "slug", "statut", "date_debut", "date_fin", seconds.alias("duree_s"))


@query(f"""
SELECT {len(TENANTS)} AS nb_tenants, {len(USERS)} AS nb_utilisateurs, (SELECT count(*) FROM fx_offer) AS nb_offres, (SELECT count(*) FROM fx_product) AS nb_referentiels, (SELECT count(*) FROM fx_session) AS nb_scrappers,
       (SELECT count(*) FROM fx_session WHERE statut = 'EN_COURS') AS nb_en_cours, (SELECT count(*) FROM fx_session WHERE statut = 'ECHOUE' AND date_debut >= (SELECT max(date_debut) FROM fx_session) - INTERVAL 24 HOUR) AS echoues_24h""")
def platform_stats(t: Tables) -> DataFrame:
    """The platform's counts in one row."""
    count = lambda df: df.agg(F.count("*")).scalar()
    last = t.runs.agg(F.max("date_debut")).scalar()
    runs = t.runs.agg(F.count("*").alias("nb_scrappers"), F.count_if(F.col("statut") == "EN_COURS").alias("nb_en_cours"), F.count_if((F.col("statut") == "ECHOUE") & (F.col("date_debut") >= last - F.expr("INTERVAL 24 HOURS"))).alias("echoues_24h"))
    return runs.select(F.lit(len(TENANTS)).alias("nb_tenants"), F.lit(len(USERS)).alias("nb_utilisateurs"), count(t.current).alias("nb_offres"), count(t.products).alias("nb_referentiels"), "nb_scrappers", "nb_en_cours", "echoues_24h")


SCOPE = f"(VALUES {', '.join(f'({t[0]}, {c})' for t in TENANTS for c in t[5])}) s(tenant_id, categorie_id)"


@query(f"""
SELECT t.tenant_id, coalesce(u.n, 0) AS nb_users, coalesce(c.n, 0) AS nb_categories, coalesce(o.n, 0) AS nb_offres, last_scrape_at
FROM (VALUES {', '.join(f'({t[0]})' for t in TENANTS)}) t(tenant_id) LEFT JOIN (SELECT tenant_id, count(*) AS n FROM (VALUES {', '.join(f'({u[0]}, {u[1]})' for u in USERS)}) x(user_id, tenant_id) GROUP BY 1) u USING (tenant_id)
LEFT JOIN (SELECT tenant_id, count(*) AS n FROM {SCOPE} GROUP BY 1) c USING (tenant_id)
LEFT JOIN (SELECT tenant_id, count(*) AS n, max(date_debut) AS last_scrape_at FROM {SCOPE} JOIN (SELECT offre_id, categorie_id, run_id FROM fx_offer_run) USING (categorie_id) JOIN (SELECT run_id, date_debut FROM fx_session) USING (run_id) GROUP BY 1) o USING (tenant_id)""")
def tenant_activity(t: Tables) -> DataFrame:
    """Users, categories, offers and the last run of each tenant; zeros for those without."""
    tenants = t.spark.createDataFrame([(x[0],) for x in TENANTS], "tenant_id long")
    offers = with_run(t).groupBy("categorie_id", "run_id").agg(F.count("*").alias("_n")).join(t.runs.select("run_id", F.col("date_debut").alias("_at")), "run_id")
    by_category = offers.groupBy("categorie_id").agg(F.sum("_n").alias("_n"), F.max("_at").alias("_at"))  # before the scope multiplies rows
    seen = t.scopes.join(by_category, "categorie_id").groupBy("tenant_id").agg(F.sum("_n").alias("nb_offres"), F.max("_at").alias("last_scrape_at"))
    out = tenants.join(t.users.groupBy("tenant_id").agg(F.count("*").alias("nb_users")), "tenant_id", "left").join(t.scopes.groupBy("tenant_id").agg(F.count("*").alias("nb_categories")), "tenant_id", "left").join(seen, "tenant_id", "left")
    return out.na.fill(0, ["nb_users", "nb_categories", "nb_offres"]).select("tenant_id", "nb_users", "nb_categories", "nb_offres", "last_scrape_at")


@query("SELECT c.categorie_id, categorie, 100 + c.categorie_id % 2 AS parent_id, count(DISTINCT produit_id) AS nb_produits, count(offre_id) AS nb_offres FROM fx_category c LEFT JOIN (SELECT categorie_id, produit_id, offre_id FROM fx_offer) USING (categorie_id) GROUP BY ALL")
def category_list(t: Tables) -> DataFrame:
    """Categories with their family, products and offers."""
    counts = t.placed.groupBy("categorie_id").agg(F.countDistinct("produit_id").alias("nb_produits"), F.count("*").alias("nb_offres"))
    return t.categories.join(t.families, "categorie_id").join(counts, "categorie_id", "left").na.fill(0, ["nb_produits", "nb_offres"])


@query("SELECT m.marque, count(offre_id) AS nb_offres FROM (SELECT DISTINCT marque FROM fx_product) m LEFT JOIN (SELECT marque AS own, offre_id FROM fx_offer) ON lower(own) = lower(m.marque) GROUP BY m.marque")
def brand_list(t: Tables) -> DataFrame:
    """Brands and their offers, whatever the case of the names."""
    counts = t.offers.groupBy(F.lower("marque").alias("_m")).agg(F.count("*").alias("nb_offres"))
    return t.products.select("marque").distinct().join(counts, F.lower("marque") == F.col("_m"), "left").select("marque", F.coalesce("nb_offres", F.lit(0).cast("long")).alias("nb_offres"))


@query("""
SELECT s.site_id, slug, coalesce(n, 0) AS nb_offres, last_scrape_at FROM fx_site s LEFT JOIN (SELECT site_id, max(date_debut) AS last_scrape_at FROM fx_session GROUP BY 1) r USING (site_id)
LEFT JOIN (SELECT r.site_id, count(*) AS n FROM fx_offer_run o JOIN fx_session r USING (run_id) GROUP BY 1) o USING (site_id)""")
def source_list(t: Tables) -> DataFrame:
    """Each site with the offers of its runs and the beginning of the last one."""
    seen = with_run(t).select("run_id").groupBy("run_id").agg(F.count("*").alias("_n"))
    rows = t.runs.join(seen, "run_id", "left").groupBy("site_id").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("nb_offres"), F.max("date_debut").alias("last_scrape_at"))
    return t.sites.join(rows, "site_id", "left").select("site_id", "slug", F.coalesce("nb_offres", F.lit(0)).cast("long").alias("nb_offres"), "last_scrape_at")


@query("""
SELECT site_id, run_id, statut, coalesce(n, 0) AS offres_collectees, CAST(epoch(date_fin) - epoch(date_debut) AS DOUBLE) AS duree_s FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date_debut DESC NULLS LAST, run_id DESC) AS r FROM fx_session) LEFT JOIN (SELECT run_id, count(*) AS n FROM fx_offer_run GROUP BY 1) USING (run_id) WHERE r <= 10""")
def source_runs(t: Tables, limit: int = 10) -> DataFrame:
    """The last runs of each site with their offers and duration."""
    by = Window.partitionBy("site_id").orderBy(F.desc_nulls_last("date_debut"), F.desc("run_id"))
    last = t.runs.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= limit)
    seen = with_run(t).groupBy("run_id").agg(F.count("*").alias("_n"))
    seconds = F.unix_seconds(F.col("date_fin").cast("timestamp")) - F.unix_seconds(F.col("date_debut").cast("timestamp"))
    return last.join(seen, "run_id", "left").select("site_id", "run_id", "statut", F.coalesce("_n", F.lit(0)).cast("long").alias("offres_collectees"), seconds.cast("double").alias("duree_s"))


@query(f"SELECT CASE WHEN offre_id % 9 > 0 THEN slug END AS site, count(*) AS stale_count FROM fx_offer_run JOIN fx_site USING (site_id) WHERE run_id <> {LATEST} GROUP BY 1")
def stale_by_site(t: Tables) -> DataFrame:
    """Offers that the last run did not see, by the site that their raw JSON tells; every ninth tells none."""
    raw = F.when(F.col("offre_id") % 9 > 0, F.to_json(F.struct(F.col("slug").alias("site_id"), "nom"))).otherwise('{"nom": "x"}')
    rows = t.offers.withColumn("run_id", 1 + F.col("offre_id") % 40).where(F.col("run_id") != latest(t)).join(t.sites, "site_id")
    return rows.groupBy(F.get_json_object(raw, "$.site_id").alias("site")).agg(F.count("*").alias("stale_count"))


@query("""
SELECT days, site_id, slug, count(*) AS total_runs, count(*) FILTER (statut = 'TERMINE') AS successful, count(*) FILTER (statut = 'ECHOUE') AS failed, max(date_debut) AS last_run_at
FROM fx_session JOIN fx_site USING (site_id), (SELECT unnest([7, 30]) AS days) WHERE date_debut >= (SELECT max(date_debut) FROM fx_session) - to_days(CAST(days AS INTEGER)) GROUP BY ALL""")
def site_runs_recent(t: Tables) -> DataFrame:
    """Runs of each site in the last 7 and 30 days, seen from the last one, and how they ended."""
    last = t.runs.agg(F.max("date_debut")).scalar()
    rows = t.runs.join(t.sites, "site_id").withColumn("days", F.explode(F.array(F.lit(7), F.lit(30)))).where(F.col("date_debut") >= last - F.make_interval(days=F.col("days")))
    state = lambda x: F.count_if(F.col("statut") == x)
    return rows.groupBy("days", "site_id", "slug").agg(F.count("*").alias("total_runs"), state("TERMINE").alias("successful"), state("ECHOUE").alias("failed"), F.max("date_debut").alias("last_run_at"))


@query("SELECT offre_id, 1 AS run, max(observed_at) AS date_debut, NULL::TIMESTAMP AS date_fin, 1 AS nb_observations, CAST(arg_max(prix_original, (observed_at, k1, k2)) AS DOUBLE) AS prix_original, arg_max(stock_status, (observed_at, k1, k2)) AS stock_status FROM fx_obs GROUP BY offre_id")
def backfilled_snapshots(t: Tables) -> DataFrame:
    """One open interval for each offer as it was seen last, as for a history that has to begin anew."""
    from ..operators import intervals

    last = t.observations.groupBy("offre_id").agg(F.max_by(F.struct("prix_original", "prix_en_promotion", "stock_status", "observed_at"), F.struct("observed_at", "k1", "k2")).alias("_v")).select("offre_id", "_v.*")
    return intervals.backfilled(last, F.col("observed_at")).select("offre_id", "run", "date_debut", "date_fin", "nb_observations", F.col("prix_original").cast("double").alias("prix_original"), "stock_status")
