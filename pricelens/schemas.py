"""Constants of the domain: enumerations, thresholds and declared schemas. Readers never infer a schema."""

from __future__ import annotations

from pyspark.sql import types as T

# Event types, in the order of their priority.
NEW_OFFER = "NOUVELLE_OFFRE_DECOUVERTE"
OUT_OF_STOCK = "RUPTURE_STOCK"
BACK_IN_STOCK = "RETOUR_STOCK"
PROMO_START = "DEBUT_PROMOTION"
PRICE_DROP = "BAISSE_PRIX"
PRICE_RISE = "HAUSSE_PRIX"
EVENT_TYPES = (NEW_OFFER, OUT_OF_STOCK, BACK_IN_STOCK, PROMO_START, PRICE_DROP, PRICE_RISE)

# Stock statuses that count as out of stock. The strict set holds the one word that event
# detection knows; the wide one adds the word that page parsers emit.
STRICT_OUT = ("RUPTURE",)
WIDE_OUT = ("RUPTURE", "OUT_OF_STOCK")

# A price moves when it changes by this share, inclusive; a position is cheaper or
# dearer than the market at these multiples, inclusive; the best price has this tolerance.
PRICE_MOVE = 0.02
CHEAPER, DEARER = 0.95, 1.05
BEST_PRICE = 1.001

# Plans in ascending order.
PLANS = ("BASIC", "MEDIUM", "PREMIUM")
SITE_PROFILE, BRAND_PROFILE = "SITE_ECOMMERCE", "MARQUE"

PRICE = T.DecimalType(10, 3)

OBSERVATION = T.StructType(
    [
        T.StructField("offre_id", T.LongType(), False),
        T.StructField("observed_at", T.TimestampNTZType(), False),
        T.StructField("prix_original", PRICE),
        T.StructField("prix_en_promotion", PRICE),
        T.StructField("prix_unitaire", PRICE),
        T.StructField("stock_status", T.StringType()),
    ]
)
RAW_OFFER = T.StructType(
    [
        T.StructField("site_id", T.StringType(), False),
        T.StructField("product_url", T.StringType(), False),
        T.StructField("category_url", T.StringType()),
        T.StructField("nom", T.StringType()),
        T.StructField("prix_original", T.StringType()),
        T.StructField("prix_final", T.StringType()),
        T.StructField("statut_stock", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("fiche_technique", T.MapType(T.StringType(), T.StringType())),
        T.StructField("scraped_at", T.TimestampNTZType()),
    ]
)
EVENT_LOG = T.StructType(
    [
        T.StructField("offre_id", T.LongType(), False),
        T.StructField("type_evenement", T.StringType(), False),
        T.StructField("valeur_avant", PRICE),
        T.StructField("valeur_apres", PRICE),
        T.StructField("date_detection", T.TimestampNTZType(), False),
    ]
)
