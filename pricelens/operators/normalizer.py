"""Offers completed from what their pages tell: canonical sheets, brands and categories; and duplicates within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import specs as S
from ..functions.text import without_query
from .dictionary import phrases_in

# A sheet's keys that name the brand, without marks and spaces, and patterns of model codes in names, in order.
BRAND_KEYS = ("marque", "brand", "fabricant", "constructeur", "marqueproduit", "marquedelarticle")
MODEL_PATTERNS = (
    r"(?i)\bCore\s+i[3579]-\d{4,5}[A-Z]*\b",
    r"(?i)\bi[3579]-\d{4,5}[A-Z]*\b",
    r"(?i)\bRyzen\s+\d+\s+\d{4}[A-Z]*\b",
    r"(?i)\b(?:RTX|GTX)\s?\d{4}\s?(?:Ti|Super|OC)?\b",
    r"(?i)\bRX\s?\d{4}\s?(?:XT|GRE)?\b",
    r"\b[A-Z]{2,6}-?\d{3,}[A-Za-z0-9-]{0,10}\b",
)


def brand_key(key: Column) -> Column:
    """A spec key in lower case without spaces and marks."""
    return F.lower(F.regexp_replace(key, r"[\s:·\-'’]+", ""))


def brand_name(name: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(name, r"\s+", " ")))


def brand_of_sheet(sheet: Column) -> Column:
    """The first value, not blank, of a key that names the brand; null if there is none."""
    found = F.filter(F.map_entries(sheet), lambda e: brand_key(e["key"]).isin(*BRAND_KEYS) & (F.btrim(F.coalesce(e["value"], F.lit(""))) != ""))
    return F.btrim(F.get(found, F.lit(0))["value"])


def model_of_name(name: Column, brand: Column) -> Column:
    """The first code in a name, its brand cut from the front; null if there is none."""
    plain = F.btrim(name)
    led = F.lower(plain).startswith(F.lower(brand)) & (brand != "")
    bare = F.when(F.coalesce(led, F.lit(False)), F.btrim(F.substring(plain, F.length(brand) + 1, F.length(plain)))).otherwise(plain)
    return F.coalesce(*(F.nullif(F.btrim(F.regexp_extract(bare, p, 0)), F.lit("")) for p in MODEL_PATTERNS))


def brands_in_names(offers: DataFrame, brands: DataFrame, key: str = "offre_id") -> DataFrame:
    """key, found: for each name, the longest of brands (marque) that stands in it at a word's beginning and ends at a mark, of equals the first in order.

    Names are cut into runs that are joined to brands by equality, so a name meets the brands that stand in it only.
    """
    known = brands.select(F.col("marque").alias("found"), brand_name(F.col("marque")).alias("phrase")).where("phrase <> ''")
    met = phrases_in(offers.select(key, F.col("nom").alias("text")), known, key).join(known, "phrase")
    best = met.groupBy(key).agg(F.min(F.struct(-F.length("phrase"), "found")).alias("_b"))
    return best.select(key, F.col("_b.found").alias("found"))


def canonical_sheets(offers: DataFrame, keys: DataFrame, key: str = "offre_id") -> DataFrame:
    """key, specs: the sheet under canonical keys. keys: site, key, canonical; others are dropped, of two for one canonical key the later stays; without one the model comes from the name.

    The brand that is cut from the name is the one that the offer had before.
    """
    rows = offers.select(key, "site", F.posexplode_outer("fiche").alias("at", "key", "value"))
    named = rows.join(keys, ["site", "key"]).groupBy(key, "canonical").agg(F.max_by("value", "at").alias("value"))
    own = named.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("canonical", "value")))).alias("specs"))
    out = offers.select(key, "nom", "marque").join(own, key, "left")
    model = model_of_name(F.col("nom"), F.coalesce("marque", F.lit("")))
    held = F.coalesce("specs", F.create_map().cast("map<string,string>"))
    wanted = ~F.map_contains_key(held, F.lit("Modèle")) & model.isNotNull()
    return out.select(key, F.when(wanted, F.map_concat(held, F.create_map(F.lit("Modèle"), model))).otherwise(held).alias("specs"))


def normalize_offers(offers: DataFrame, brands: DataFrame, keys: DataFrame, places: DataFrame, key: str = "offre_id") -> DataFrame:
    """offers (nom, fiche, site, category_url, marque, categorie_id) with specs, and brand and category where they are missing.

    A brand comes from the sheet, in its known spelling if it has one, else from the name; a category
    from the url (cut at its query) by places: site, url, categorie_id; of several the least.
    """
    known = brands.select(brand_name(F.col("marque")).alias("_bare"), F.col("marque").alias("_known")).groupBy("_bare").agg(F.min("_known").alias("_known"))
    at = places.groupBy("site", "url").agg(F.min("categorie_id").alias("_place"))
    rows = offers.join(canonical_sheets(offers, keys, key), key).join(brands_in_names(offers, brands, key), key, "left")
    rows = rows.withColumn("_told", brand_of_sheet(F.col("fiche"))).join(known, brand_name(F.col("_told")) == F.col("_bare"), "left")
    rows = rows.withColumn("url", without_query(F.col("category_url"))).join(at, ["site", "url"], "left")
    rows = rows.withColumn("marque", F.coalesce(F.nullif("marque", F.lit("")), "_known", "_told", "found")).withColumn("categorie_id", F.coalesce("categorie_id", "_place"))
    return rows.drop("_told", "_bare", "_known", "found", "url", "_place")


def missing(offers: DataFrame) -> DataFrame:
    """Offers that lack a sheet, a brand or a category."""
    return offers.where("specs is null or marque is null or categorie_id is null")


def first_of_alike(offers: DataFrame, key: str, category: Column, brand: Column, sheet: Column) -> DataFrame:
    """offers with survivor: the least key among those of the same category, brand (trimmed, in lower case, null as empty) and canonical sheet. Offers without sheet or category are left out."""
    rows = offers.where(sheet.isNotNull() & category.isNotNull())
    told = rows.withColumns({"_c": category, "_b": F.lower(F.btrim(F.coalesce(brand, F.lit("")))), "_s": F.xxhash64(S.canonical_json(sheet)), "_j": S.canonical_json(sheet)})
    least = told.groupBy("_c", "_b", "_s", "_j").agg(F.min(key).alias("survivor"))
    return told.join(least, ["_c", "_b", "_s", "_j"]).drop("_c", "_b", "_s", "_j")


def one_for_each_url(offers: DataFrame, url: str, key: str, product: Column, sheet: Column) -> DataFrame:
    """offers with a url, with rank and copies: of one trimmed url those with a product first, then those with a sheet that is not empty, then by key."""
    bare = F.btrim(F.col(url))
    full = sheet.isNotNull() & (F.size(sheet) > 0)
    by = Window.partitionBy(bare).orderBy(F.when(product.isNotNull(), 0).otherwise(1), F.when(full, 0).otherwise(1), key)
    return offers.where(bare != "").withColumn("rank", F.row_number().over(by)).withColumn("copies", F.count("*").over(Window.partitionBy(bare)))


def bootstrap(offers: DataFrame) -> DataFrame:
    """reference_id and columns of a reference for each offer with a category and no product; its number is the offer's, offre_ids holds the offer."""
    rows = offers.where("categorie_id is not null and produit_id is null")
    return rows.select(F.col("offre_id").alias("reference_id"), F.coalesce("nom", F.lit("(sans nom)")).alias("nom_produit"), "marque", "categorie_id", F.array("offre_id").alias("offre_ids"))
