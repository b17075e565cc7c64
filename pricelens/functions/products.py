"""Product pages of shops of three kinds: a struck price, a badge, and embedded JSON. Statuses are the shops' own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .pages import element, spec_sheet, text_of
from .prices import join_price, parse_plain_price, parse_price, promotion
from .text import clean
from .variants import at, node_of_type, strings

# Statuses by class, by the text of the label, and by the availability that is embedded, in the order in which they are asked.
BY_LABEL = (("IN_STOCK", "in-stock", "en stock"), ("OUT_OF_STOCK", "out-of-stock", "rupture|épuisé"), ("ARRIVING", None, "arrivage"), ("ON_ORDER", None, "commande"))
BY_AVAILABILITY = (("IN_STOCK", "InStock"), ("OUT_OF_STOCK", "OutOfStock"), ("ON_ORDER", "PreOrder"))
UNKNOWN = "UNKNOWN"


def attribute(html: Column, tag: str, mark: str, name: str) -> Column:
    """An attribute of the first element of a tag whose opening holds mark (a pattern); null without or if empty."""
    found = F.regexp_extract(F.coalesce(html, F.lit("")), rf'(?is)<{tag}\b(?=[^>]*{mark})[^>]*?\s{name}="([^"]*)"', 1)
    return F.nullif(found, F.lit(""))


def css(name: str) -> str:
    return rf'\bclass="[^"]*\b{name}\b[^"]*"'


def availability(html: Column) -> Column:
    return F.coalesce(attribute(html, "link", 'itemprop="availability"', "href"), F.lit(""))


def stock(html: Column, label: str = "stock") -> Column:
    """The status that a page's label tells by its class or text, else by the embedded availability; UNKNOWN without."""
    kind, text, link = (F.coalesce(x, F.lit("")) for x in (attribute(html, "span", css(label), "class"), element(html, "span", label), availability(html)))
    out = F.lit(UNKNOWN)
    for status, word in reversed(BY_AVAILABILITY):
        out = F.when(F.contains(link, F.lit(word)), status).otherwise(out)
    for status, name, words in reversed(BY_LABEL):
        told = text.rlike(f"(?iU){words}")
        out = F.when(F.contains(kind, F.lit(name)) | told if name else told, status).otherwise(out)
    return out


def struck(html: Column) -> Column:
    """A page with the final price (its content attribute before its text) and perhaps a struck one: a promotion if that is higher."""
    final = parse_price(F.coalesce(attribute(html, "span", css("current-price"), "content"), element(html, "span", "current-price")))
    original, promo = promotion(parse_price(element(html, "span", "regular-price")), final)
    image = F.coalesce(attribute(html, "img", css("cover"), "data-image-large-src"), attribute(html, "img", css("cover"), "src"), attribute(html, "img", css("thumb"), "data-image-large-src"), attribute(html, "img", css("thumb"), "src"))
    return F.struct(
        element(html, "h1").alias("nom"), original.alias("prix_original"), promo.alias("prix_en_promotion"), promo.isNotNull().alias("est_en_promotion"), stock(html).alias("statut_stock"), image.alias("image_url"),
        clean(element(html, "div", "description")).alias("description"), spec_sheet(html).alias("fiche_technique"),
    )


def badge(html: Column) -> Column:
    """A page on promotion if it has a badge with a text: the price is the promotional one, and the regular one, if it is there, the original."""
    price = parse_price(attribute(html, "span", 'itemprop="price"', "content"))
    on = element(html, "div", "discount-details").isNotNull()
    regular = element(html, "span", "regular-price")
    crumbs = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?is)<span itemprop="name">(.*?)</span>'), F.lit(1)), text_of)
    trail = let(crumbs, lambda c: F.when(F.size(c) > 2, F.array_join(F.slice(c, F.lit(2), F.size(c) - 2), " > ")))
    return F.struct(
        element(html, "h1").alias("nom"), F.when(on & regular.isNotNull(), parse_price(regular)).otherwise(price).alias("prix_original"), F.when(on, price).alias("prix_en_promotion"), on.alias("est_en_promotion"),
        parse_price(element(html, "span", "unit-price")).alias("prix_unitaire"), element(html, "p", "manufacturer_product").alias("marque"), trail.alias("categorie_brute"),
        F.when(F.contains(availability(html), F.lit("InStock")), "IN_STOCK").otherwise("OUT_OF_STOCK").alias("statut_stock"),
    )


def script(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(html, F.lit("")), rf'(?is)<script\b[^>]*\bid="{name}"[^>]*>(.*?)</script>', 1), F.lit(""))


def embedded(html: Column) -> Column:
    """A page with its product and its trail in JSON-LD, of any shape: alone, in an array, in a graph. The price is in two elements, whole and part; a brand counts as an object with a name only."""
    name = element(html, "h1")

    def product(v: Column) -> Column:
        one = lambda key: F.nullif(F.get(strings(v, at(key)), F.lit(0)), F.lit(""))
        return F.struct(F.try_variant_get(v, '$.brand.name', "string").alias("marque"), F.coalesce(one("description"), element(html, "div", "description")).alias("description"), F.coalesce(one("weight"), one("size")).alias("quantite"))

    def trail(v: Column) -> Column:
        names = F.transform(F.coalesce(F.try_variant_get(v, "$.itemListElement", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.try_variant_get(x, "$.name", "string"))
        return F.nullif(F.array_join(F.filter(names, lambda n: (F.coalesce(n, F.lit("")) != "") & (n != "Home") & ~n.eqNullSafe(name)), " > "), F.lit(""))

    return F.struct(
        name.alias("nom"), join_price(element(html, "span", "price-int"), element(html, "span", "price-dec")).alias("prix_original"), parse_plain_price(element(html, "span", "unit-price")).alias("prix_unitaire"),
        let(node_of_type(script(html, "product-schema-ldjson"), "Product"), product).alias("donnees"), let(node_of_type(script(html, "breadcrumb-schema-ldjson"), "BreadcrumbList"), trail).alias("categorie_brute"),
    )


def overridden(listed: Column, own: Column, other: Column | None = None) -> Column:
    """What the listing told before what the product's page tells; empty texts count as nothing."""
    told = F.coalesce(F.nullif(listed, F.lit("")), F.nullif(own, F.lit("")))
    return told if other is None else F.coalesce(told, other)
