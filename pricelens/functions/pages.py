"""What shop pages tell, by expressions over their HTML: links, pagination, spec sheets, stock and embedded data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, one_for_each
from .prices import parse_price
from .text import clean, page_number

# Texts of several sites' stock labels, and the values of embedded data that mean the same, in the order in which they are asked.
STOCK = (("IN_STOCK", "en stock|disponible|instock"), ("RUPTURE", "rupture|epuis|épuis|outofstock|hors stock"), ("SUR_COMMANDE", "sur commande|preorder"))


def origin(url: Column) -> Column:
    """Scheme and host of a url; empty without."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-z]+://[^/?#]+", 0)


def absolute(link: Column, url: Column) -> Column:
    """A link as seen from a page: one with a scheme as it is, else below the page's host."""
    host = origin(url)
    return F.when(link.rlike("^[a-z]+://"), link).when(link.startswith("//"), F.concat(F.lit("http:"), link)).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(host, F.lit("/"), link))


def links(html: Column, url: Column) -> Column:
    """The distinct links of a page as structs of url and name, in their order; scripts and places within the page are left out. Of equal urls the first stays."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>.*?</a>'), F.lit(0))
    told = F.transform(found, lambda a: F.struct(F.regexp_extract(a, r'(?i)\bhref="([^"]*)"', 1).alias("link"), text_of(a).alias("name")))
    kept = F.filter(told, lambda x: (x["link"] != "") & ~x["link"].startswith("#") & ~F.lower(x["link"]).startswith("javascript"))
    return one_for_each(F.transform(kept, lambda x: F.struct(absolute(x["link"], url).alias("url"), x["name"].alias("name"))), "url")


def text_of(html: Column) -> Column:
    """The text of a piece of HTML: tags out, the common entities read, blanks squeezed; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(mark))
    return clean(F.regexp_replace(bare, r"\s+", " "))


def element(html: Column, tag: str, css: str | None = None) -> Column:
    """The text of the first element of a tag (and class); null without."""
    mark = rf'[^>]*\bclass="[^"]*\b{css}\b[^"]*"' if css else "[^>]*"
    return text_of(F.nullif(F.regexp_extract(F.coalesce(html, F.lit("")), rf"(?is)<{tag}\b{mark}[^>]*>(.*?)</{tag}>", 1), F.lit("")))


def next_page(url: Column, html: Column) -> Column:
    """The url of the listing's next page: null where this one's number is the greatest that its links have."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"[?&](?:page|p)=(\d+)"), F.lit(1)), lambda x: x.try_cast("long"))
    here = page_number(url)
    bare = F.regexp_replace(F.regexp_replace(url, r"([?&])(?:page|p)=\d+&?", "$1"), "[?&]$", "")
    there = F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit("page="), (here + 1).cast("string"))
    return F.when(F.coalesce(F.array_max(numbers), F.lit(0)) > here, there)


def spec_sheet(html: Column) -> Column:
    """A page's sheet as a map: names and values of a definition list, up to the shorter of both, else rows of a table with <th> and <td>. Blank names and values are left out; of equal names the last stays."""
    cells = lambda tag: F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), text_of)

    def paired(names: Column, values: Column) -> Column:
        rows = let(F.struct(names.alias("names"), values.alias("values")), lambda x: F.transform(
            F.slice(x["names"], F.lit(1), F.least(F.size(x["names"]), F.size(x["values"]))), lambda k, i: F.struct(k.alias("key"), F.get(x["values"], i).alias("value"))
        ))
        return F.map_from_entries(one_for_each(F.filter(rows, lambda r: r["key"].isNotNull() & r["value"].isNotNull()), "key", last=True))

    return let(paired(cells("dt"), cells("dd")), lambda listed: F.when(F.size(listed) > 0, listed).otherwise(paired(cells("th"), cells("td"))))


def stock_status(label: Column) -> Column:
    """The stock status that a label tells, asked in a fixed order; null if it tells none."""
    low, out = F.lower(label), F.lit(None).cast("string")
    for status, words in reversed(STOCK):
        out = F.when(low.rlike(words), status).otherwise(out)
    return out


def embedded(html: Column) -> Column:
    """The page's JSON-LD as text; an empty object where there is none."""
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)
    return F.when(F.get_json_object(found, "$").isNotNull(), found).otherwise("{}")


def product(html: Column) -> Column:
    """name, price, brand, description of a product page: by its JSON-LD, else by its heading and its price element."""
    data = embedded(html)
    field = lambda *paths: F.coalesce(*(F.get_json_object(data, p) for p in paths))
    price = F.coalesce(field("$.offers.price", "$.offers[0].price").try_cast("double"), parse_price(element(html, "span", "price")))
    return F.struct(F.coalesce(field("$.name"), element(html, "h1")).alias("name"), price.alias("price"), field("$.brand.name", "$.brand").alias("brand"), field("$.description").alias("description"))


def image_id(url: Column) -> Column:
    """The product number in an image's url, without a 1 at its end; null without."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"/(\d+?)1?\.(?:jpg|jpeg|png|webp)", 1)
    return F.nullif(found, F.lit(""))
