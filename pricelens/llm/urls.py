"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host + path, with literal tokens that every URL it matches
holds. It is filed under the token that the fewest URLs hold; a URL's tokens fetch the rules filed
under them, and only those run their expression.
"""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import quoted

#: verdict, host and path: fits the host and all its subdomains, if the path starts with the rule's.
HOST_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Words of addresses that are blocked: alone, and after each of the words before them.
TOPICS = ["casino", "poker", "slots", "roulette", "betting", "jackpot", "porn", "xxx", "cams", "escort", "viagra", "cialis", "pharmacy", "payday", "loans", "torrent", "warez", "keygen", "cracks", "serials", "replica", "diploma"]
BEFORE = ["free", "online", "best", "cheap", "live", "hot", "top", "new", "real", "buy"]
FILES = ["exe", "apk", "msi", "dmg", "iso", "zip", "rar", "bat"]
EDGE, END = "(?:^|[./_-])", "(?:[./_-]|$)"


def pattern_rules() -> list[tuple[str, str, list[str]]]:
    """verdict, expression over host + path, its literal tokens, in the order in which they are asked, where no host rule fits.

    A token is literal if it stands whole, between marks, in every address that the expression matches.
    A rule may have none: then every address runs it.
    """
    rules = [("allow", rf"{EDGE}{t}[._-](?:law|history|research){END}", [t]) for t in TOPICS]
    rules += [("block", rf"{EDGE}{b}[._-]{t}{END}", [b, t]) for t in TOPICS for b in BEFORE]
    rules += [("block", rf"{EDGE}{t}{END}", [t]) for t in TOPICS]
    rules += [("block", r"/wp-(?:login|admin)(?:[./]|$)", ["wp"]), ("block", r"/cgi-bin/", ["cgi", "bin"])]
    rules += [("block", rf"\.{f}$", [f]) for f in FILES]
    return rules + [("block", r"(?:^|[./])[0-9]{12,}(?:[./]|$)", []), ("block", r"^[^/]*xn--", [])]


PATTERN_RULES = pattern_rules()
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lower-cased, and path; both empty for null and for URLs without it."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def tokens(address: Column) -> Column:
    """Distinct runs of ASCII letters and digits, as they are written."""
    return F.array_distinct(F.regexp_extract_all(address, F.lit("[0-9A-Za-z]+"), 0))


def rules_frame(spark: SparkSession, host_rules=tuple(HOST_RULES), pattern_rules=tuple(PATTERN_RULES)) -> DataFrame:
    """rule, verdict, pattern, tokens, rank: the greatest rank among the rules that fit decides."""
    rows = []
    for verdict, rule in host_rules:
        host, path = rule.split("/", 1)
        rows.append((rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", _bounded(host, path), 1_000_000 + len(rule)))
    rows += [(None, verdict, pattern, words, -k) for k, (verdict, pattern, words) in enumerate(pattern_rules)]
    return spark.createDataFrame(rows, "rule string, verdict string, pattern string, tokens array<string>, rank long")


def _bounded(host: str, path: str) -> list[str]:
    """The tokens of a host rule that stand whole in each URL it fits: those with a mark on either side."""
    whole = re.findall(r"[0-9A-Za-z]+", f"{host}/")
    return whole + re.findall(r"[0-9A-Za-z]+(?=[^0-9A-Za-z])", path)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """pages with the columns host, path, rule and verdict (columns of those names are replaced).

    The verdict is that of the longest host rule that fits (of equals the later in byte order), else
    of the first pattern rule that matches, else default; rule is null unless a host rule decides.
    A null URL, or one without ``://``, has empty host and path, which no rule fits. Each different
    host + path is judged once, whatever number of rows have it, and every row keeps its place in the
    result, repeated rows too. A rule without tokens is filed under the empty token, which every address
    has. Addresses of any length are taken whole. An empty table gives an empty one. Sides are broadcast
    by Spark if they are small.
    """
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col("url"))
    addressed = pages.select(F.struct(*(F.col(quoted(c)) for c in columns)).alias("_page"), host.alias("host"), path.alias("path"))
    addressed = addressed.withColumn("address", F.concat("host", "path"))
    held = F.array_append(tokens(F.col("address")), F.lit(""))
    judged = addressed.select("address").where("address <> ''").distinct().withColumn("token", F.explode(held))
    filed = F.when(F.size("tokens") > 0, F.array_distinct("tokens")).otherwise(F.array(F.lit("")))
    spread = rules.withColumn("token", F.explode(filed))
    # How many addresses hold each token of the rules: one row a token, so it is as small as the rules.
    counts = judged.join(spread.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    weighed = spread.join(counts, "token", "left")
    index = weighed.groupBy("pattern", "rank").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"), F.first("verdict").alias("verdict"), F.first("rule").alias("rule"))
    fits = judged.join(index, "token").where(F.expr("address rlike pattern"))
    best = fits.groupBy("address").agg(F.max(F.struct("rank", "rule", "verdict")).alias("_best"))
    out = addressed.join(best, "address", "left")
    kept = [F.col("_page").getField(c).alias(c) for c in columns]
    return out.select(*kept, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    def fit(rule: str) -> str:
        host, path = rule.split("/", 1)
        return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '/{path}')"

    longest = sorted(HOST_RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {fit(r)} THEN '{r}'" for _, r in longest)
    verdict = " ".join(f"WHEN {fit(r)} THEN '{v}'" for v, r in longest)
    for v, same in groupby(PATTERN_RULES, key=lambda r: r[0]):  # the first that matches: neighbours of one verdict are asked at once
        verdict += f" WHEN regexp_matches(host || path, '{'|'.join(p for _, p, _ in same)}') THEN '{v}'"
    rest = "CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    return f"""
WITH cut AS (SELECT page_id, {rest} AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE '{DEFAULT}' END AS verdict FROM parts"""


OP4_SQL = _oracle()
