"""Queries over listed offers: spec sheets made comparable, and the matching cascade against the references of site 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import specs, text
from ..operators import matching, normalizer
from ..registry import query
from ..tables import Tables


@query("""
SELECT offre_id, CASE WHEN site_id = 3 AND produit_id % 5 = 0 THEN cap * 2 ELSE cap END || 'gb' AS memoire, '15.6in' AS ecran, '2.5ghz' AS frequence,
       lower(replace(code, '-', '')) AS modele, cap || 'gb' AS capacite FROM fx_listing""")
def spec_values(t: Tables) -> DataFrame:
    """Memory, screen, frequency, model code and capacity of each listed offer in one spelling, whatever its site's."""
    value = lambda k: specs.normalize_value(F.lit(k), F.element_at("fiche", F.lit(k)))
    return t.listings.select(
        "offre_id", value("Mémoire vive").alias("memoire"), value("Taille de l'écran").alias("ecran"), value("Fréquence").alias("frequence"),
        specs.model_slugs(F.col("fiche"), F.col("nom")).getItem(0).alias("modele"), specs.capacities(F.col("nom")).getItem(0).alias("capacite"),
    )


def sheets(t: Tables) -> DataFrame:
    """Listed offers as the matcher takes them: normalised once, as their sheets are asked for several times."""
    profile = matching.COMPUTERS
    return t.listings.select(
        "offre_id", "site_id", "produit_id", "nom", "categorie_id", "vector", text.slug(F.col("marque")).alias("marque_slug"),
        specs.normalize_specs(F.col("fiche"), profile.exclude_keys).alias("specs"), specs.model_slugs(F.col("fiche"), F.col("nom"), profile.from_name, profile.skip).alias("models"),
    )


def offers_and_references(t: Tables, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Both sides, of some columns if asked for: kept, as each is read several times."""
    rows = storage.stored(sheets(t).select(*columns or "*"), "sheets")
    return rows.where("site_id <> 0"), rows.where("site_id = 0").withColumnRenamed("offre_id", "reference_id")


def near(t: Tables, offers: DataFrame, references: DataFrame) -> DataFrame:
    return matching.candidates(offers, references, t.families)


@query("""
WITH q AS (SELECT * FROM fx_listing WHERE site_id <> 0), r AS (SELECT * FROM fx_listing WHERE site_id = 0),
pool AS (SELECT q.offre_id, r.offre_id AS reference_id, list_cosine_similarity(q.vector, r.vector) AS s FROM q JOIN r ON q.marque = r.marque AND q.categorie_id % 2 = r.categorie_id % 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY offre_id ORDER BY round(s, 9) DESC, reference_id) AS rank FROM pool)
SELECT offre_id, reference_id, round(round(s, 9), 6) AS s_semantic, rank FROM ranked WHERE rank <= 15""")
def match_candidates(t: Tables) -> DataFrame:
    """The candidates of each offer: its brand's references in the categories of its family, the 15 nearest."""
    return near(t, *offers_and_references(t, "offre_id", "site_id", "categorie_id", "marque_slug", "vector")).select("offre_id", "reference_id", F.round("s_semantic", 6).alias("s_semantic"), "rank")


#: The cascade in SQL over the listings: what each offer and reference is after normalisation, the pairs of match_candidates, common subsequences by a bit for each letter, and the score.
CASCADE = """
listed AS (SELECT l.offre_id, l.site_id, l.produit_id, l.marque, l.categorie_id, vector, cap, lower(replace(code, '-', '')) AS model, CASE WHEN site_id = 3 AND produit_id % 5 = 0 THEN cap * 2 ELSE cap END AS held,
  array_to_string(list_sort(list_filter(string_split(l.marque || ' ' || p.nom || ' ' || code || ' ' || cap || CASE site_id WHEN 0 THEN 'Go' WHEN 1 THEN ' GB' WHEN 2 THEN 'gb' ELSE ' go' END, ' '), lambda x: x <> '')), ' ') AS words FROM fx_listing l JOIN fx_product p USING (produit_id)),
pool AS (SELECT q.offre_id, r.offre_id AS reference_id, coalesce(round(list_cosine_similarity(q.vector, r.vector), 9), 0) AS sem, q.vector IS NULL OR r.vector IS NULL AS bare FROM listed q JOIN listed r ON q.site_id <> 0 AND r.site_id = 0 AND q.marque = r.marque AND q.categorie_id % 2 = r.categorie_id % 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY offre_id ORDER BY sem DESC, reference_id) AS rank FROM pool),
text AS (SELECT DISTINCT words AS s FROM listed UNION SELECT DISTINCT model FROM listed),
letter AS (SELECT s, CAST(ascii(substr(s, i::int, 1)) AS HUGEINT) AS c, sum(CAST(1 AS HUGEINT) << (i::int - 1)) AS mask FROM text, generate_series(1, 100) g(i) WHERE i <= length(s) GROUP BY ALL),
masks AS (SELECT s, map_from_entries(list((c, mask))) AS m FROM letter GROUP BY s),
pairs AS (SELECT DISTINCT q.words AS a, r.words AS b FROM ranked k JOIN listed q ON q.offre_id = k.offre_id JOIN listed r ON r.offre_id = k.reference_id WHERE rank <= 15 UNION SELECT DISTINCT q.model, r.model FROM ranked k JOIN listed q ON q.offre_id = k.offre_id JOIN listed r ON r.offre_id = k.reference_id WHERE rank <= 15),
states AS (
  SELECT a, b, list_reduce(list_prepend((CAST(1 AS HUGEINT) << length(a)) - 1, list_transform(string_split(b, ''), lambda x: CAST(ascii(x) AS HUGEINT))),
    lambda s, c: ((s + (s & coalesce(m[c], 0))) | (s - (s & coalesce(m[c], 0)))) & ((CAST(1 AS HUGEINT) << length(a)) - 1)) AS state FROM pairs JOIN masks ON masks.s = pairs.a),
ratios AS (SELECT a, b, 2.0::DOUBLE * (length(a) - bit_count(state)) / (length(a) + length(b)) AS ratio FROM states),
signals AS (
  SELECT k.offre_id, k.reference_id, k.rank, k.sem, m.ratio AS model, n.ratio AS name, CASE WHEN q.model = r.model THEN 0 ELSE 1 END + CASE WHEN q.held = r.held THEN 0 ELSE 1 END AS n_conflict, CASE WHEN q.held = r.held THEN 0 ELSE 1 END AS n_hard, q.cap <> r.cap AS other_capacity
  FROM ranked k JOIN listed q ON q.offre_id = k.offre_id JOIN listed r ON r.offre_id = k.reference_id JOIN ratios m ON m.a = q.model AND m.b = r.model JOIN ratios n ON n.a = q.words AND n.b = r.words WHERE rank <= 15),
one AS (SELECT *, (5 - n_conflict) / 5.0::DOUBLE AS spec, 0.40::DOUBLE * model + 0.25::DOUBLE * ((5 - n_conflict) / 5.0::DOUBLE) + 0.20::DOUBLE * sem + 0.15::DOUBLE * name AS t0 FROM signals),
two AS (SELECT *, CASE WHEN n_hard >= 1 THEN greatest(0, t0 - CASE WHEN model >= 0.99 THEN least(n_hard * 0.07::DOUBLE, 0.20) ELSE least(n_hard * 0.15::DOUBLE, 0.45) END) ELSE t0 END AS t1 FROM one),
three AS (SELECT *, CASE WHEN model < 0.68 THEN greatest(0, t1 - 0.25::DOUBLE) WHEN model < 0.95 THEN greatest(0, t1 - 0.10::DOUBLE) ELSE t1 END AS t2 FROM two),
scored AS (SELECT *, round(CASE WHEN model >= 0.95 AND other_capacity THEN greatest(0, t2 - 0.30::DOUBLE) ELSE t2 END, 4) AS score FROM three),
best AS (SELECT *, round(score - coalesce(lead(score) OVER w, 0), 4) AS margin, row_number() OVER w AS nth FROM scored WINDOW w AS (PARTITION BY offre_id ORDER BY score DESC, rank)),
decided AS (
  SELECT *, CASE WHEN score >= 0.74 AND model >= 0.97 AND margin >= 0.10 AND round(sem, 3) >= 0.75 THEN 'AUTO' WHEN score >= 0.32 THEN 'REVIEW' ELSE 'NO_MATCH' END AS layer FROM best WHERE nth = 1)"""


#: The matcher of one stage: all of the brand's references, other weights and thresholds, no vectors and no margin.
ONE_STAGE = CASCADE.replace("coalesce(round(list_cosine_similarity(q.vector, r.vector), 9), 0) AS sem", "0.0::DOUBLE AS sem").replace(" AND q.categorie_id % 2 = r.categorie_id % 2", "").replace("rank <= 15", "true")
ONE_STAGE = ONE_STAGE.replace("0.40::DOUBLE * model", "0.50::DOUBLE * model").replace("0.25::DOUBLE * ((5", "0.35::DOUBLE * ((5").replace("score >= 0.74 AND model >= 0.97 AND margin >= 0.10 AND round(sem, 3) >= 0.75", "score >= 0.72 AND model >= 0.97").replace("score >= 0.32", "score >= 0.30")


@query(f"""WITH {CASCADE.strip()}
SELECT offre_id, reference_id, score, round(model, 3) AS s_model, round(spec, 3) AS s_spec, round(name, 3) AS s_name, 5 AS n_common, n_conflict, n_hard, margin, layer,
  CASE WHEN layer = 'REVIEW' AND score >= 0.74 THEN CASE WHEN model < 0.97 THEN 'model<0.97' WHEN margin < 0.10 THEN 'margin<0.1' WHEN round(sem, 3) < 0.75 THEN 'semantic<0.75' ELSE '' END ELSE '' END AS reason, false AS relaxed FROM decided""")
def match_decisions(t: Tables) -> DataFrame:
    """The best reference of each offer, its score and margin, and whether it is linked, reviewed or dropped."""
    offers, references = offers_and_references(t)
    return matching.matched(offers, references, t.families).select("offre_id", "reference_id", "score", "s_model", "s_spec", "s_name", "n_common", "n_conflict", "n_hard", "margin", "layer", "reason", "relaxed")


@query(f"""WITH {ONE_STAGE.strip()}
SELECT offre_id, reference_id, score, round(model, 3) AS s_model, round(name, 3) AS s_name, n_hard, layer FROM decided""")
def one_stage_decisions(t: Tables) -> DataFrame:
    """The older matcher's decision on each offer."""
    offers, references = offers_and_references(t)
    return matching.one_stage(offers, references).select("offre_id", "reference_id", "score", "s_model", "s_name", "n_hard", "layer")


@query(f"""WITH {CASCADE.strip()}
SELECT CAST(100 + categorie_id % 2 AS VARCHAR) AS family, count(*) AS total, count(*) FILTER (layer = 'AUTO') AS auto, count(*) FILTER (layer = 'REVIEW') AS review, count(*) FILTER (layer = 'NO_MATCH') AS no_match FROM decided JOIN fx_listing USING (offre_id) GROUP BY ROLLUP (CAST(100 + categorie_id % 2 AS VARCHAR))""")
def match_summary(t: Tables) -> DataFrame:
    """Offers of each layer, by family and in all."""
    offers, references = offers_and_references(t)
    placed = matching.matched(offers, references, t.families).join(offers.select("offre_id", "categorie_id"), "offre_id").join(t.families.select("categorie_id", F.col("parent_id").cast("string").alias("family")), "categorie_id")
    return matching.buckets(placed)


@query("""
SELECT offre_id, min(offre_id) OVER (PARTITION BY categorie_id, marque, cap, couleur, groupe_id) AS survivor FROM fx_listing WHERE site_id = 0""")
def offer_duplicates(t: Tables) -> DataFrame:
    """For each offer of a site, the first with its category, brand and sheet (the model left out): what is not its own survivor goes."""
    rows = t.listings.where("site_id = 0")
    sheet = F.map_filter(F.map_concat("fiche", F.create_map(F.lit("groupe"), F.col("groupe_id").cast("string"))), lambda k, v: k != "Modèle")
    return normalizer.first_of_alike(rows, "offre_id", F.col("categorie_id"), F.col("marque"), sheet).select("offre_id", "survivor")


@query("""
SELECT url, min_by(offre_id, (CASE WHEN produit_id % 2 = 0 THEN 0 ELSE 1 END, offre_id)) AS offre_id, count(*) AS n
FROM (SELECT 'http://shop/' || groupe_id AS url, * FROM fx_listing) GROUP BY url""")
def url_survivors(t: Tables) -> DataFrame:
    """The one offer that stays of each url: one with a product (here: an even one) before one without, then the least id."""
    rows = t.listings.withColumn("url", F.concat(F.lit(" http://shop/"), F.col("groupe_id").cast("string"), F.lit(" ")))
    ranked = normalizer.one_for_each_url(rows, "url", "offre_id", F.when(F.col("produit_id") % 2 == 0, F.col("produit_id")), F.col("fiche"))
    return ranked.where("rank = 1").select(F.btrim("url").alias("url"), "offre_id", F.col("copies").alias("n"))


def raw_offers(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Offers as they were read, and the brands, keys and places that they are normalised by."""
    offers = t.listings.withColumn("fiche", F.when(F.col("produit_id") % 3 == 0, F.map_filter("fiche", lambda k, v: k != "Marque")).otherwise(F.col("fiche")))
    offers = offers.select("offre_id", "nom", "fiche", F.col("site_id").cast("string").alias("site"), F.concat(F.lit("http://shop/"), F.col("categorie_id").cast("string"), F.lit("?page=2")).alias("category_url"), F.lit(None).cast("string").alias("marque"), F.lit(None).cast("long").alias("categorie_id"))
    brands = t.products.select("marque").distinct()
    keys = t.spark.createDataFrame([(str(s), k, v) for s in range(4) for k, v in (("Mémoire vive", "ram"), ("Modèle", "Modèle"))], "site string, key string, canonical string")
    places = t.spark.range(1, 7).select(F.explode(F.array(*(F.lit(str(s)) for s in range(4)))).alias("site"), F.concat(F.lit("http://shop/"), F.col("id").cast("string")).alias("url"), F.col("id").alias("categorie_id"))
    return offers, brands, keys, places


@query("""
SELECT offre_id, marque AS brand, '{"Modèle":"' || code || '","ram":"' || CASE site_id WHEN 0 THEN held || ' Go' WHEN 1 THEN held || 'GB' WHEN 2 THEN held || ' gb' ELSE held * 1000 || ' Mo' END || '"}' AS specs, categorie_id
FROM (SELECT *, CASE WHEN site_id = 3 AND produit_id % 5 = 0 THEN cap * 2 ELSE cap END AS held FROM fx_listing)""")
def normalized_offers(t: Tables) -> DataFrame:
    """Every offer with brand, category and canonical sheet filled in. A third have no brand on their sheet, and take it from their name."""
    out = normalizer.normalize_offers(*raw_offers(t))
    sheet = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("specs"))))
    return out.select("offre_id", F.col("marque").alias("brand"), sheet.alias("specs"), "categorie_id")


@query("""
SELECT offre_id, marque AS brand, '{"Modèle":"' || code || '","ram":"' || CASE site_id WHEN 0 THEN held || ' Go' WHEN 1 THEN held || 'GB' WHEN 2 THEN held || ' gb' ELSE held * 1000 || ' Mo' END || '"}' AS specs, categorie_id
FROM (SELECT *, CASE WHEN site_id = 3 AND produit_id % 5 = 0 THEN cap * 2 ELSE cap END AS held FROM fx_listing) WHERE site_id = 1 AND produit_id % 13 <> 5""")
def resumed_normalisation(t: Tables) -> DataFrame:
    """The offers of one site normalised by a stage that is lost after two of its four lots and run again; those whose sheet cannot be read are put aside."""
    from ..operators import stages

    raw, brands, keys, places = raw_offers(t)
    lots: list[int] = []

    def work(lot: DataFrame) -> DataFrame:
        lots.append(1)
        if len(lots) == 3:
            raise InterruptedError("the run is lost")
        bad = F.expr("offre_id div 10 % 13 = 5")
        good = normalizer.normalize_offers(lot.where(~bad), brands, keys, places)
        told = good.select("offre_id", F.col("marque").alias("brand"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("specs")))).alias("specs"), "categorie_id", F.lit(None).cast("string").alias("reason"))
        return told.unionByName(lot.where(bad).select("offre_id", F.lit("no sheet").alias("reason")), allowMissingColumns=True)

    stage = stages.Stage(t.spark, storage.shared_folder(t.spark, "normalise"), "offre_id", "brand string, specs string, categorie_id long", 1)
    asked = normalizer.missing(raw.where("site = '1'").withColumn("specs", F.lit(None).cast("map<string,string>"))).drop("specs")
    try:
        stage.run(asked, work, 4)
    except InterruptedError:
        stage.run(asked, work, 4)
    return stage.done().select(F.col("offre_id").cast("long").alias("offre_id"), "brand", "specs", "categorie_id")
