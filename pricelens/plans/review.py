"""The review queue: candidates, what people decided on them, statistics; scopes under quotas; sheets of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import commands, matching
from ..registry import query
from ..tables import Tables

#: Candidates of pairs of offers, a part each, and a log of commands on them, an event of the log each.
CANDIDATES = """
SELECT k AS candidat_id, k * 10 + k % 5 AS offre_a_id, k * 10 + (k + 1) % 5 AS offre_b_id, CASE WHEN k % 3 > 0 THEN k END AS referentiel_id, CASE WHEN k % 19 > 0 THEN round(CAST(p_retailprice AS DOUBLE) / 1000, 4) END AS score,
       CASE WHEN k % 11 = 0 THEN 'VALIDE' WHEN k % 13 = 0 THEN 'REJETE' ELSE 'INCERTAIN' END AS statut, CASE WHEN k % 2 = 0 THEN k % 4 END AS id_validateur,
       CASE WHEN k % 7 = 0 THEN 'broken {' WHEN k % 7 < 6 THEN concat('{"reason": "", "s_model": ', CAST(k % 100 AS STRING), ', "s_name": 0.5, "offer_models": ["m', CAST(k AS STRING), '"], "ref_models": null, "justification": "near"}') END AS commentaire
FROM (SELECT CAST(p_partkey AS BIGINT) AS k, p_retailprice FROM part)"""
LOG = """
SELECT 1 + event_id % 400 AS candidat_id, ts AS moment, event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'validate' WHEN 1 THEN 'reject' WHEN 2 THEN 'correct' WHEN 3 THEN 'bulk_validate' WHEN 4 THEN 'bulk_reject' WHEN 5 THEN 'reopen' ELSE 'validate' END AS action,
       CASE WHEN event_id % 4 = 0 THEN user_id END AS referentiel_id, CASE WHEN event_id % 5 = 0 THEN value / 100 END AS score FROM events"""


def candidates(t: Tables) -> DataFrame:
    return t.sql(CANDIDATES, "part")


def log(t: Tables) -> DataFrame:
    return t.sql(LOG, "events")


FOLD = f"""
cand AS ({CANDIDATES}), cmd AS (SELECT *, row_number() OVER (PARTITION BY candidat_id ORDER BY moment, seq) AS n FROM ({LOG})),
fold AS (
  SELECT candidat_id, CAST(0 AS BIGINT) AS n, statut, referentiel_id, score, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS avant, CAST(NULL AS VARCHAR) AS refus FROM cand
  UNION ALL
  SELECT candidat_id, n, CASE WHEN refus IS NULL AND action LIKE '%validate' THEN 'VALIDE' WHEN refus IS NULL AND action LIKE '%reject' THEN 'REJETE' ELSE statut END,
    CASE WHEN refus IS NULL AND action = 'validate' THEN coalesce(cref, ref, -candidat_id) WHEN refus IS NULL AND action = 'correct' THEN coalesce(cref, ref) ELSE ref END,
    CASE WHEN refus IS NULL AND action = 'correct' THEN coalesce(cscore, score) ELSE score END, seq, action, statut, refus
  FROM (SELECT f.candidat_id, c.n, f.statut, f.referentiel_id AS ref, c.referentiel_id AS cref, f.score, c.score AS cscore, c.seq, c.action,
      CASE WHEN c.action = 'reopen' THEN 'unknown action' WHEN c.action LIKE 'bulk%' AND f.statut <> 'INCERTAIN' THEN 'not open' WHEN c.action LIKE '%validate' AND f.statut = 'VALIDE' THEN 'already validated'
        WHEN c.action LIKE '%reject' AND f.statut = 'REJETE' THEN 'already rejected' WHEN c.action = 'correct' AND c.referentiel_id IS NULL AND c.score IS NULL THEN 'no fields to update' END AS refus
    FROM fold f JOIN cmd c ON c.candidat_id = f.candidat_id AND c.n = f.n + 1))"""


@query(f"""
WITH RECURSIVE {FOLD}
SELECT candidat_id, arg_max(statut, n) AS statut, CAST(arg_max({{'x': referentiel_id}}, n).x AS VARCHAR) AS referentiel_id, arg_max({{'x': score}}, n).x AS score, count(*) - 1 AS commandes, count(refus) AS refusees FROM fold GROUP BY candidat_id""")
def review_states(t: Tables) -> DataFrame:
    """Each candidate after all commands of the log, with how many there were and how many were refused."""
    rows = candidates(t)
    return commands.states(rows, commands.outcomes(rows, log(t))).withColumn("referentiel_id", F.col("referentiel_id").cast("string"))


@query(f"""
WITH RECURSIVE {FOLD}
SELECT candidat_id, seq, CASE WHEN action LIKE '%validate' THEN 'CANDIDAT_VALIDE' WHEN action LIKE '%reject' THEN 'CANDIDAT_REJETE' ELSE 'CANDIDAT_CORRIGE' END AS action, avant, statut AS apres FROM fold WHERE n > 0 AND refus IS NULL""")
def review_audit(t: Tables) -> DataFrame:
    """The audit of what the commands did."""
    return commands.audit(commands.outcomes(candidates(t), log(t)))


@query(f"""
WITH RECURSIVE {FOLD},
last AS (SELECT candidat_id, arg_max(statut, n) AS statut, arg_max({{'x': referentiel_id}}, n).x AS r FROM fold GROUP BY candidat_id),
side AS (SELECT candidat_id, unnest([offre_a_id, offre_b_id]) AS offre_id FROM cand)
SELECT offre_id, arg_max(r, candidat_id) AS produit_id FROM last JOIN side USING (candidat_id) WHERE statut = 'VALIDE' AND r IS NOT NULL GROUP BY offre_id""")
def reviewed_links(t: Tables) -> DataFrame:
    """The product that the validated candidates give to each of their offers."""
    rows = candidates(t)
    return commands.linked_offers(rows, commands.states(rows, commands.outcomes(rows, log(t))))


#: Plans of forty tenants, and their commands: an event each.
SMALL_QUOTAS = {"BASIC": 3, "MEDIUM": 6}
TENANT = "SELECT k AS tenant_id, CASE k % 3 WHEN 0 THEN 'BASIC' WHEN 1 THEN 'MEDIUM' ELSE 'PREMIUM' END AS plan FROM (SELECT DISTINCT user_id % 40 AS k FROM events)"
HELD = "SELECT DISTINCT user_id % 40 AS tenant_id, 1 + user_id % 40 % 6 AS categorie_id FROM events"
SCOPE_LOG = "SELECT user_id % 40 AS tenant_id, ts AS moment, event_id AS seq, CASE WHEN event_id % 3 > 0 THEN 'add' ELSE 'remove' END AS action, CASE WHEN event_id % 3 > 0 THEN {both} ELSE {one} END AS categories FROM events"


@query(f"""
WITH RECURSIVE log AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY moment, seq) AS n FROM ({SCOPE_LOG.format(both='[1 + event_id % 20, 1 + event_id * 7 % 20]', one='[1 + event_id % 20]')})),
fold AS (
  SELECT tenant_id, plan, CAST(0 AS BIGINT) AS n, held, 0 AS added, CAST(NULL AS VARCHAR) AS refus FROM ({TENANT}) JOIN (SELECT tenant_id, list_sort(list(categorie_id)) AS held FROM ({HELD}) GROUP BY 1) USING (tenant_id)
  UNION ALL
  SELECT tenant_id, plan, n, CASE WHEN refus IS NOT NULL THEN held WHEN action = 'add' THEN list_sort(list_concat(held, more)) ELSE list_filter(held, lambda x: x <> categories[1]) END, CASE WHEN refus IS NULL AND action = 'add' THEN len(more) ELSE 0 END, refus
  FROM (SELECT f.tenant_id, plan, l.n, held, action, categories, list_distinct(list_filter(categories, lambda x: NOT list_contains(held, x))) AS more,
      CASE WHEN action = 'add' AND len(held) + len(categories) > CASE plan WHEN 'BASIC' THEN 3 WHEN 'MEDIUM' THEN 6 ELSE 1000000 END THEN 'quota' WHEN action = 'remove' AND len(held) <= 1 THEN 'last category'
        WHEN action = 'remove' AND NOT list_contains(held, categories[1]) THEN 'not in scope' END AS refus
    FROM fold f JOIN log l ON l.tenant_id = f.tenant_id AND l.n = f.n + 1))
SELECT tenant_id, array_to_string(arg_max(held, n), ',') AS categories, CAST(sum(added) AS BIGINT) AS ajoutees, count(*) FILTER (refus = 'quota') AS quota, count(*) FILTER (refus = 'last category') AS derniere, count(*) FILTER (refus = 'not in scope') AS absente FROM fold GROUP BY tenant_id""")
def scope_commands(t: Tables) -> DataFrame:
    """Scopes of tenants after their commands under quotas of 3 and 6 categories, with what was added and refused."""
    asked = t.sql(SCOPE_LOG.format(both="array(1 + event_id % 20, 1 + event_id * 7 % 20)", one="array(1 + event_id % 20)"), "events")
    done = commands.scope_outcomes(t.sql(TENANT, "events"), t.sql(HELD, "events"), asked, SMALL_QUOTAS)
    why = lambda x, name: F.count_if(F.col("refus") == x).alias(name)
    scope = F.array_join(F.first("categories", ignorenulls=True).cast("array<string>"), ",")
    return done.groupBy("tenant_id").agg(scope.alias("categories"), F.coalesce(F.sum("ajoutees"), F.lit(0).cast("long")).alias("ajoutees"), why("quota", "quota"), why("last category", "derniere"), why("not in scope", "absente"))


def queue(t: Tables, statut: str | None = None, site: str | None = None, low: float | None = None, high: float | None = None, page: int = 1, limit: int = 50) -> DataFrame:
    """A page of candidates with both offers and their sites, by score, nulls last; site asks for either side. Offers of a run that there is not have no site."""
    run = t.runs.where("run_id <= 35").select("run_id", "site_id").join(t.sites, "site_id").select("run_id", "slug")

    def side(x: str) -> DataFrame:
        rows = t.offers.select(F.col("offre_id").alias(f"offre_{x}_id"), F.col("nom").alias(f"nom_{x}"), F.col("marque").alias(f"marque_{x}"), (1 + F.col("offre_id") % 40).alias("run_id"))
        return rows.join(run, "run_id", "left").drop("run_id").withColumnRenamed("slug", f"site_{x}")

    rows = candidates(t).join(side("a"), "offre_a_id").join(side("b"), "offre_b_id")
    asked: list[Column] = []
    if statut:
        asked.append(F.col("statut") == statut)
    if low is not None:
        asked.append(F.col("score") >= low)
    if high is not None:
        asked.append(F.col("score") <= high)
    if site:
        asked.append((F.col("site_a") == site) | (F.col("site_b") == site))
    for c in asked:
        rows = rows.where(c)
    total = rows.agg(F.count("*")).scalar()
    out = rows.orderBy(F.desc_nulls_last("score"), "candidat_id").offset((page - 1) * limit).limit(limit)
    return out.select("candidat_id", "offre_a_id", "nom_a", "marque_a", "site_a", "offre_b_id", "nom_b", "marque_b", "site_b", "score", "statut", total.alias("total"), F.ceil(total / limit).alias("pages"))


def queue_sql(where: str, page: int, limit: int) -> str:
    return f"""
WITH cand AS ({CANDIDATES}), run AS (SELECT run_id, slug FROM fx_session JOIN fx_site USING (site_id) WHERE run_id <= 35), side AS (SELECT o.offre_id, o.nom, o.marque, slug FROM fx_offer_run o LEFT JOIN run USING (run_id)),
rows AS (SELECT candidat_id, offre_a_id, a.nom AS nom_a, a.marque AS marque_a, a.slug AS site_a, offre_b_id, b.nom AS nom_b, b.marque AS marque_b, b.slug AS site_b, score, statut FROM cand JOIN side a ON a.offre_id = offre_a_id JOIN side b ON b.offre_id = offre_b_id)
SELECT *, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / {limit}) AS BIGINT) AS pages FROM rows WHERE {where} ORDER BY score DESC NULLS LAST, candidat_id LIMIT {limit} OFFSET {(page - 1) * limit}"""


@query(queue_sql("true", 1, 50))
def review_queue(t: Tables) -> DataFrame:
    """The first page of candidates."""
    return queue(t)


@query(queue_sql("statut = 'INCERTAIN' AND score >= 0.91 AND score <= 0.999 AND (site_a = 'asia' OR site_b = 'asia')", 2, 10))
def review_queue_filtered(t: Tables) -> DataFrame:
    """The second page of open candidates within a range of scores, with a side on one site."""
    return queue(t, "INCERTAIN", "asia", 0.91, 0.999, 2, 10)


@query(f"""
WITH cand AS ({CANDIDATES}), linked AS (SELECT count(*) FILTER (offre_id % 3 = 0) AS m, count(*) AS n FROM fx_offer)
SELECT count(*) AS total, count(*) FILTER (statut = 'INCERTAIN') AS incertain, count(*) FILTER (statut = 'VALIDE') AS valide, count(*) FILTER (statut = 'REJETE') AS rejete, round(avg(score), 6) AS avg_score,
       round(count(*) FILTER (statut = 'VALIDE' AND id_validateur IS NULL) * 100.0 / nullif(count(*) FILTER (statut = 'VALIDE'), 0), 2) AS taux_auto, round(count(*) FILTER (statut = 'VALIDE' AND id_validateur IS NOT NULL) * 100.0 / nullif(count(*) FILTER (statut = 'VALIDE'), 0), 2) AS taux_humaine,
       any_value(m) AS offres_matchees, any_value(n - m) AS offres_non_matchees FROM cand, linked""")
def matching_stats(t: Tables) -> DataFrame:
    """Candidates by status, shares decided by rule and by people, and offers with and without product (here: every third has one)."""
    is_ = lambda s: F.col("statut") == s
    good, auto = is_(commands.ACCEPTED), F.col("id_validateur").isNull()
    share = lambda c: F.round(F.try_divide(F.count_if(good & c) * 100.0, F.nullif(F.count_if(good), F.lit(0))), 2).cast("double")
    linked = t.placed.agg(F.count_if(F.col("offre_id") % 3 == 0).alias("offres_matchees"), F.count_if(F.col("offre_id") % 3 != 0).alias("offres_non_matchees"))
    rows = candidates(t).agg(F.count("*").alias("total"), F.count_if(is_(commands.OPEN)).alias("incertain"), F.count_if(good).alias("valide"), F.count_if(is_(commands.REJECTED)).alias("rejete"), F.round(F.avg("score"), 6).alias("avg_score"), share(auto).alias("taux_auto"), share(~auto).alias("taux_humaine"))
    return rows.crossJoin(linked)  # one row each


@query(f"""
WITH cand AS ({CANDIDATES}), good AS (SELECT candidat_id, CAST(commentaire AS JSON) AS j FROM cand WHERE json_valid(commentaire))
SELECT candidat_id, 'model' AS critere, CAST(j->>'s_model' AS DOUBLE) AS score, 'offer=[''' || (j->'offer_models'->>0) || '''] ref=None' AS detail FROM good
UNION ALL SELECT candidat_id, 'name', 0.5, NULL FROM good""")
def candidate_criteria(t: Tables) -> DataFrame:
    """The signals that are told in each candidate's comment; none for a comment that cannot be read."""
    return matching.criteria(candidates(t), "candidat_id").select("candidat_id", "critere", "score", "detail")


@query("""
WITH sheet AS (SELECT l.*, 2 + (l.produit_id + l.site_id) % 4 AS n, p.nom FROM fx_listing l JOIN fx_product p USING (produit_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY produit_id ORDER BY n DESC, site_id) AS r FROM sheet) WHERE r = 1)
SELECT produit_id AS reference_id, n AS cles, trim(nom || ' | ' || marque || ' | ' || CASE WHEN n >= 3 THEN 'memoire vive=' || CASE WHEN site_id = 3 AND produit_id % 5 = 0 THEN cap * 2 ELSE cap END || 'gb' ELSE '' END || CASE WHEN n >= 4 THEN ' taille de l ecran=15.6in' ELSE '' END) AS texte FROM best""")
def reference_texts(t: Tables) -> DataFrame:
    """Each reference with the number of keys of the richest sheet among its offers (the first of equals), and the text that is embedded for it.

    Offers of a product tell two to five keys, by site.
    """
    keys = F.array(*(F.lit(k) for k in ("Marque", "Modèle", "Mémoire vive", "Taille de l'écran", "Fréquence")))
    n = (2 + (F.col("produit_id") + F.col("site_id")) % 4).cast("int")
    offers = t.listings.select("offre_id", F.map_from_arrays(F.slice(keys, F.lit(1), n), F.transform(F.slice(keys, F.lit(1), n), lambda k: F.element_at("fiche", k))).alias("specs"))
    members = F.array(*((F.col("produit_id") * 10 + s).cast("long") for s in range(4)))
    references = t.products.select(F.col("produit_id").alias("reference_id"), "nom", "marque", members.alias("offre_ids"))
    rich = matching.richest_sheets(references, offers)
    return rich.select("reference_id", F.size("specs").cast("long").alias("cles"), matching.embedding_text(F.col("nom"), F.col("marque"), F.col("specs"), matching.COMPUTERS.hard_keys).alias("texte"))
