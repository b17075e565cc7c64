"""Shop texts parsed over whole tables. The driver's tables hold numbers, so price texts are written from them in four spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, pages, prices, products, specs, text, variants
from ..registry import query
from ..tables import Tables


def price_labels(t: Tables) -> DataFrame:
    """produit_id, price, label: 1.234,5 TND, 1234.5 DT, "1 234,5" with a non-breaking space, and a text without a price."""
    price = F.col("p_retailprice").cast("double")
    spelt = price.cast("string")
    comma = F.replace(spelt, F.lit("."), F.lit(","))
    grouped = lambda mark: F.regexp_replace(comma, r"^(\d)(\d{3}),", f"$1{mark}$2,")
    kind = F.col("p_partkey") % 4
    label = F.when(kind == 0, F.concat(grouped("."), F.lit(" TND"))).when(kind == 1, F.concat(spelt, F.lit(" DT TTC"))).when(kind == 2, grouped("\u00a0")).otherwise("sur demande")
    return t.spread(t.raw("part"), "p_partkey").select(F.col("p_partkey").cast("long").alias("produit_id"), price.alias("price"), label.alias("label"))


@query("""
SELECT CAST(p_partkey AS BIGINT) AS produit_id, CASE WHEN p_partkey % 4 < 3 THEN CAST(p_retailprice AS DOUBLE) END AS prix FROM part""")
def parsed_prices(t: Tables) -> DataFrame:
    """The price in each label: the number from which it was written."""
    return price_labels(t).select("produit_id", prices.parse_price(F.col("label")).alias("prix"))


@query("""
SELECT CAST(p_partkey AS BIGINT) AS produit_id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_retailprice AS DOUBLE) ELSE 1000.0 END AS prix_original,
       CASE WHEN p_partkey % 3 > 0 AND p_retailprice < 1000 THEN CAST(p_retailprice AS DOUBLE) END AS prix_en_promotion,
       CASE WHEN p_partkey % 3 > 0 AND p_retailprice < 1000 THEN round((1 - CAST(p_retailprice AS DOUBLE) / 1000.0) * 100) END AS remise
FROM part WHERE p_partkey % 3 = 0 OR p_retailprice < 1000
UNION ALL SELECT CAST(p_partkey AS BIGINT), CAST(p_retailprice AS DOUBLE), NULL, NULL FROM part WHERE p_partkey % 3 > 0 AND p_retailprice >= 1000""")
def derived_promotions(t: Tables) -> DataFrame:
    """Promotions from a struck price of 1000, which two of three products show, and the final price."""
    final = F.col("p_retailprice").cast("double")
    original, promotional = prices.promotion(F.when(F.col("p_partkey") % 3 > 0, F.lit(1000.0)), final)
    return t.spread(t.raw("part"), "p_partkey").select(F.col("p_partkey").cast("long").alias("produit_id"), original.alias("prix_original"), promotional.alias("prix_en_promotion"), prices.discount_percent(original, promotional).cast("double").alias("remise"))


@query("""
SELECT trim(regexp_replace(translate(lower(p_name), 'àâäéèêëîïôöùûüç', 'aaaeeeeiioouuuc'), '[^a-z0-9]+', ' ', 'g')) AS cle, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS marque, count(*) AS nb
FROM part GROUP BY ALL""")
def normalized_names(t: Tables) -> DataFrame:
    """Products by normalised name and brand."""
    return t.raw("part").groupBy(text.normalize_key(F.col("p_name")).alias("cle"), text.slug(F.col("p_brand")).alias("marque")).agg(F.count("*").alias("nb"))


@query(r"""
SELECT CAST(page_id AS BIGINT) AS page_id, split_part(url, '?', 1) AS url, coalesce(TRY_CAST(nullif(regexp_extract(url, '[?&](?:page|p)=(\d+)', 1), '') AS BIGINT), 1) AS page FROM pages""")
def listing_pages(t: Tables) -> DataFrame:
    """Each page's url without its query, and its number in a listing."""
    return t.raw("pages").select(F.col("page_id").cast("long").alias("page_id"), text.without_query(F.col("url")).alias("url"), text.page_number(F.col("url")).alias("page"))


def product_html(t: Tables) -> DataFrame:
    """page_id, html, listed_stock: a product page for each part, of a name, a price of 1000 struck on two of three, a label or a link for the stock, images and a sheet."""
    k = F.col("p_partkey")
    line = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    price = F.col("p_retailprice").cast("double").cast("string")
    label = F.when(k % 6 == 0, '<span class="stock in-stock"> </span>').when(k % 6 == 1, '<span class="stock x">Rupture &amp; fin</span>').when(k % 6 == 2, '<span class="stock">Arrivage lundi</span>').when(k % 6 == 3, '<span class="stock">Sur commande</span>').when(k % 6 == 4, '<link itemprop="availability" href="http://schema.org/OutOfStock">').otherwise("")
    image = F.when(k % 3 == 0, line('<img class="cover" data-image-large-src="/large/', k.cast("string"), '1.jpg" src="/small.jpg">')).when(k % 3 == 1, line('<img class="cover" src="/img/', k.cast("string"), '1.jpg">')).otherwise("")
    html = line(
        "<h1>", F.col("p_name"), " <b>x</b></h1>", F.when(k % 2 == 0, line('<span class="current-price" content="', price, '">?</span>')).otherwise(line('<span class="current-price">', price, " DT</span>")),
        F.when(k % 3 > 0, '<span class="regular-price">1.000,0 TND</span>').otherwise(""), label, image, '<div class="description"> bon produit </div>',
        "<dl><dt>Marque</dt><dd>", F.col("p_brand"), "</dd><dt>Vide</dt><dd> </dd><dt>Taille</dt><dd>1</dd><dt>Taille</dt><dd>", F.col("p_size").cast("string"), " cm</dd><dt>seul</dt></dl>",
    )
    return t.spread(t.raw("part"), "p_partkey").select(k.cast("long").alias("page_id"), html.alias("html"), F.when(k % 7 == 0, "IN_STOCK").when(k % 7 == 1, "").alias("listed_stock"))


STRUCK = """
SELECT CAST(p_partkey AS BIGINT) AS page_id, p_name || ' x' AS nom, CASE WHEN p_partkey % 3 > 0 AND p_retailprice < 1000 THEN 1000.0 ELSE CAST(p_retailprice AS DOUBLE) END AS prix_original,
       CASE WHEN p_partkey % 3 > 0 AND p_retailprice < 1000 THEN CAST(p_retailprice AS DOUBLE) END AS prix_en_promotion, p_partkey % 3 > 0 AND p_retailprice < 1000 AS est_en_promotion,
       CASE WHEN p_partkey % 7 = 0 THEN 'IN_STOCK' ELSE ['IN_STOCK', 'OUT_OF_STOCK', 'ARRIVING', 'ON_ORDER', 'OUT_OF_STOCK', 'UNKNOWN'][p_partkey % 6 + 1] END AS statut_stock,
       CASE p_partkey % 3 WHEN 0 THEN '/large/' || p_partkey || '1.jpg' WHEN 1 THEN '/img/' || p_partkey || '1.jpg' END AS image_url, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_partkey AS VARCHAR) END AS image_id, 'bon produit' AS description,
       '{"Marque":"' || p_brand || '","Taille":"' || p_size || ' cm"}' AS fiche FROM part"""


@query(STRUCK)
def product_pages(t: Tables) -> DataFrame:
    """Product pages read: prices, promotion, stock (what the listing told goes first), image and its number, description and sheet."""
    rows = product_html(t).select("page_id", "listed_stock", products.struck(F.col("html")).alias("p"))
    return rows.select(
        "page_id", "p.nom", "p.prix_original", "p.prix_en_promotion", "p.est_en_promotion", products.overridden(F.col("listed_stock"), F.col("p.statut_stock"), F.lit(products.UNKNOWN)).alias("statut_stock"), "p.image_url",
        pages.image_id(F.col("p.image_url")).alias("image_id"), "p.description", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("p.fiche_technique")))).alias("fiche"),
    )


@query("""
SELECT CAST(k AS BIGINT) AS page_id, CASE WHEN k % 8 = 0 THEN 1200.0 ELSE price END AS prix_original, CASE WHEN k % 4 = 0 THEN price END AS prix_en_promotion, k % 4 = 0 AS est_en_promotion, CASE WHEN k % 5 = 0 THEN 2.5 END AS prix_unitaire, p_brand AS marque,
       CASE WHEN k % 3 > 0 THEN p_type || CASE WHEN k % 3 = 2 THEN ' > sous' ELSE '' END END AS categorie_brute, CASE WHEN k % 2 = 0 THEN 'IN_STOCK' ELSE 'OUT_OF_STOCK' END AS statut_stock FROM (SELECT *, p_partkey AS k, CAST(p_retailprice AS DOUBLE) AS price FROM part)""")
def badge_pages(t: Tables) -> DataFrame:
    """Product pages whose promotion is told by a badge; a blank badge tells none."""
    k, text = F.col("p_partkey"), F.lit
    crumb = lambda c: F.concat(text('<li><span itemprop="name">'), c, text("</span></li>"))
    html = F.concat(
        text("<h1>n</h1>"), text('<span itemprop="price" content="'), F.col("p_retailprice").cast("double").cast("string"), text('"></span>'), F.when(k % 4 == 0, '<div class="discount-details">-10%</div>').when(k % 4 == 1, '<div class="discount-details"> </div>').otherwise(""),
        F.when(k % 8 == 0, '<span class="regular-price">1 200,0 TND</span>').otherwise(""), F.when(k % 5 == 0, '<span class="unit-price">2,5 TND / kg</span>').otherwise(""), text('<p class="manufacturer_product"><a>'), F.col("p_brand"), text("</a></p><ol>"),
        crumb(text("Accueil")), F.when(k % 3 > 0, crumb(F.col("p_type"))).otherwise(""), F.when(k % 3 == 2, crumb(text("sous"))).otherwise(""), crumb(text("n")), text("</ol>"), F.when(k % 2 == 0, '<link itemprop="availability" href="http://schema.org/InStock"/>').otherwise(""),
    )
    rows = t.spread(t.raw("part"), "p_partkey").select(k.cast("long").alias("page_id"), products.badge(html).alias("p"))
    return rows.select("page_id", "p.prix_original", "p.prix_en_promotion", "p.est_en_promotion", "p.prix_unitaire", "p.marque", "p.categorie_brute", "p.statut_stock")


@query("""
SELECT CAST(k AS BIGINT) AS page_id, CAST(floor(price) AS DOUBLE) + 0.5 AS prix_original, CASE WHEN k % 5 < 3 THEN p_brand END AS marque, CASE WHEN k % 5 = 4 THEN 'repli' ELSE 'desc ' || k END AS description, CASE WHEN k % 5 = 4 THEN NULL WHEN k % 2 = 0 THEN '1 kg' ELSE '75 cl' END AS quantite,
       CASE WHEN k % 3 = 0 THEN NULL ELSE p_type || ' > Epicerie' END AS categorie_brute FROM (SELECT *, p_partkey AS k, CAST(p_retailprice AS DOUBLE) AS price FROM part)""")
def embedded_pages(t: Tables) -> DataFrame:
    """Product pages with JSON-LD: an object, an array, a graph, a brand that is a text, and broken JSON."""
    k, text = F.col("p_partkey"), F.lit
    data = F.to_json(F.struct(F.array(F.lit("Thing"), F.lit("Product")).alias("@type"), F.struct(F.col("p_brand").alias("name")).alias("brand"), F.concat(text("desc "), k.cast("string")).alias("description"), F.when(k % 2 == 0, "1 kg").alias("weight"), text("75 cl").alias("size")))
    flat = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_brand").alias("brand"), F.concat(text("desc "), k.cast("string")).alias("description"), F.when(k % 2 == 0, "1 kg").alias("weight"), text("75 cl").alias("size")))
    other = text('{"@type": "WebSite", "description": "site"}')
    json = F.when(k % 5 == 0, data).when(k % 5 == 1, F.concat(text("["), other, text(","), data, text("]"))).when(k % 5 == 2, F.concat(text('{"@graph": ['), other, text(","), data, text("]}"))).when(k % 5 == 3, flat).otherwise("{broken")
    crumbs = F.when(k % 3 == 0, '{"itemListElement": "none"}').otherwise(F.concat(text('{"@type": "BreadcrumbList", "itemListElement": [{"name": "Home"}, {"name": "'), F.col("p_type"), text('"}, {"x": 1}, {"name": "Epicerie"}, {"name": "nom"}]}')))
    html = F.concat(text('<h1>nom</h1><span class="price-int">'), F.floor(F.col("p_retailprice").cast("double")).cast("string"), text('</span><span class="price-dec">,5</span><div class="description">repli</div><script id="product-schema-ldjson" type="application/ld+json">'), json, text('</script><script id="breadcrumb-schema-ldjson">'), crumbs, text("</script>"))
    rows = t.spread(t.raw("part"), "p_partkey").select(k.cast("long").alias("page_id"), products.embedded(html).alias("p"))
    return rows.select("page_id", "p.prix_original", "p.donnees.*", "p.categorie_brute")


@query("""
SELECT offre_id, CASE WHEN categorie_id % 6 = 0 THEN NULL WHEN site_id = 3 THEN NULL ELSE CAST(categorie_id AS VARCHAR) END AS categorie_id FROM fx_listing""")
def assigned_categories(t: Tables) -> DataFrame:
    """The category of each offer by the url of its listing, cut at its query. A category tells its urls in JSON: a text on site 0, an array on site 1, either on site 2, null on site 3; the sixth one's is broken."""
    c, url = F.col("categorie_id"), F.concat(F.lit('"http://shop/'), F.col("categorie_id").cast("string"), F.lit('"'))
    json = F.concat(F.lit('{"0": '), url, F.lit(', "1": ["http://other", '), url, F.lit('], "2": '), F.when(c % 2 == 0, url).otherwise(F.concat(F.lit("["), url, F.lit("]"))), F.lit(', "3": null'), F.when(c % 6 == 0, "").otherwise("}"))
    there = variants.places(t.categories.select("categorie_id", json.alias("urls")), "categorie_id", "urls").groupBy("site", "url").agg(F.min("categorie_id").alias("categorie_id"))
    offers = t.listings.select("offre_id", F.col("site_id").cast("string").alias("site"), text.without_query(F.concat(F.lit("http://shop/"), F.col("categorie_id").cast("string"), F.lit("?page=2"))).alias("url"))
    return offers.join(there, ["site", "url"], "left").select("offre_id", F.col("categorie_id").cast("string").alias("categorie_id"))


@query("""
SELECT CAST(k AS BIGINT) AS id, price AS simple, floor(price) + 0.5 AS joint, CASE WHEN k % 5 < 4 THEN round(price / (1 - (k % 5) * 10 / 100.0), 3) END AS avant, CASE WHEN k % 3 = 0 THEN 'Stable vs hier' WHEN k % 3 = 1 THEN '↑ ' || k || ' vs hier (+' || CAST(floor(k / greatest(1, 100 - k) * 100 + 0.5) AS BIGINT) || '%)' ELSE '↓ ' || k || ' vs hier' END AS delta,
       CASE WHEN k % 4 = 0 THEN 0.0 ELSE round(k * 100.0 / (k % 4 * 50), 1) END AS part, ['OUI', 'NON', 'INCERTAIN', 'INCERTAIN'][k % 4 + 1] AS decision, CASE k % 4 WHEN 3 THEN 'sans avis ' || k WHEN 2 THEN 'doute ' || k ELSE 'motif ' || k END AS motif,
       ['DIRECT', 'DOCUMENTS', 'HYBRID', 'DB_TOOLS'][k % 4 + 1] AS route, CASE WHEN k % 2 = 0 THEN p_brand || '|rapport ' || k ELSE '' END AS sources, ['product', 'preference', 'context'][k % 3 + 1] AS fait, k % 2 = 0 AS connu, k % 3 < 2 AS cle_dure
FROM (SELECT *, p_partkey AS k, CAST(p_retailprice AS DOUBLE) AS price FROM part)""")
def told_texts(t: Tables) -> DataFrame:
    """Texts that people and models write, read: prices in two more spellings, discounts, changes, shares, a judge's answers, routes of questions, cited sources, kinds of facts, and keys of a profile. They are written from the parts."""
    k, price = F.col("p_partkey"), F.col("p_retailprice").cast("double")
    say = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    of = lambda n, *texts: F.get(F.array(*(x if not isinstance(x, str) else F.lit(x) for x in texts)), k % n)
    num = k.cast("string")
    answer = of(4, say("blah DECISION: oui — motif ", num), say("DECISION:NON : motif ", num), say("DECISION: Incertain - doute ", num), say("sans avis ", num))
    told = labels.judged(answer)
    cited = F.when(k % 2 == 0, say("vu [Source: ", F.col("p_brand"), "] et [source:rapport ", num, " ] et encore [Source: ", F.col("p_brand"), "]"))
    old = F.array(F.when(k % 2 == 0, "surveille les téléviseurs samsung").otherwise("autre chose"))
    return t.spread(t.raw("part"), "p_partkey").select(
        k.cast("long").alias("id"), prices.parse_plain_price(say(F.replace(price.cast("string"), F.lit("."), F.lit(",")), " DT")).alias("simple"), prices.join_price(say(F.floor(price).cast("string"), " "), F.lit(",5")).alias("joint"),
        prices.original_before(price, F.when(k % 5 < 4, (k % 5) * 10).otherwise(100)).alias("avant"), labels.day_delta(of(3, F.lit(0).cast("long"), k.cast("long"), -k.cast("long")), F.lit(100).cast("long")).alias("delta"), labels.percent(k, (k % 4) * 50, 1).cast("double").alias("part"),
        told["decision"].alias("decision"), told["justification"].alias("motif"),
        labels.route(of(4, "Salut !", "Que dit le rapport 2024 sur les prix ?", "compare les prix", "compare les prix"), of(4, F.lit(None).cast("string"), "hybrid", "Route: hybrid.", "je ne sais pas")).alias("route"),
        F.array_join(text.cited_sources(cited), "|").alias("sources"), labels.fact_kind(of(3, "aime cette Marque", "veut un format court", "rien"), (("product", ("produit", "marque")), ("preference", ("format",)))).alias("fait"),
        labels.known_fact(F.lit("regarde téléviseurs samsung"), old).alias("connu"), specs.key_matches(of(3, "Mémoire  vive (RAM)", "Disque dur SSD", "Couleur"), ("ram", "stockage")).alias("cle_dure"),
    )
