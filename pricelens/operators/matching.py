"""The matching cascade: blocking by brand and family, the nearest references, a score of four signals, and a decision."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..functions.specs import capacities, key_matches, key_matches_any, normalize_value, phrases
from ..functions.text import normalize_key
from . import pairs
from .nearest import listed


@dataclass(frozen=True)
class Profile:
    """What a family of categories asks of a match. The fixed values are those of a family without a profile of its own."""

    name: str = "generic"
    hard_keys: tuple[str, ...] = ("capacite", "taille", "puissance", "volume", "type")
    exclude_keys: tuple[str, ...] = ("couleur", "poids", "garantie", "dimensions")
    from_name: bool = False
    skip: tuple[str, ...] = field(default=())
    auto: float = 0.78
    review: float = 0.35
    margin: float = 0.12
    semantic: float = 0.80


# What the four signals count in a score.
MODEL, SPEC, SEMANTIC, NAME = 0.40, 0.25, 0.20, 0.15
# What a conflict of hard keys takes off, each and at most: where models are alike from SAME_MODEL on, and elsewhere.
SAME_MODEL, HARD_SAME, HARD_OTHER = 0.99, (0.07, 0.20), (0.15, 0.45)
# What unlike models take off, below each ratio; and capacities that differ in names of like models.
UNLIKE = ((0.68, 0.25), (0.95, 0.10))
CAPACITY = (0.95, 0.30)
# Fixed value: the ratio of models that a link asks for.
LINKED_MODEL = 0.97
# The profile of computers. Others are given by the caller.
COMPUTERS = Profile(
    "informatique",
    ("ram", "processeur", "stockage", "taille_ecran", "resolution", "carte_graphique", "gpu", "vram", "type_stockage"),
    ("couleur", "poids", "dimensions", "garantie", "systeme", "connectivite", "bluetooth", "wifi"),
    True,
    ("USB", "HDMI", "RGB", "SSD", "DDR4", "DDR5", "NVMe", "WiFi", "Bluetooth"),
    0.74, 0.32, 0.10, 0.75,
)


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, by a bit for each letter of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & at.get(c, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common length over both lengths; 1 for two empty texts."""
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def token_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of two texts whose words are sorted; null counts as empty."""
    bare = lambda x: " ".join(sorted((x or "").split()))
    return pd.Series([ratio(bare(x), bare(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def best_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The greatest ratio of a text of one list and one of the other; 0 if one is empty."""
    return pd.Series([max((ratio(p, q) for p in x for q in y), default=0.0) if x is not None and y is not None else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def spec_facts(a: Column, b: Column, hard_keys: tuple[str, ...] | Column) -> Column:
    """score, n_common, n_conflict, n_hard of two normalised sheets; a score of 0 without common keys. hard_keys: keys, or a column of their phrases."""
    hard = (lambda k: key_matches_any(k, hard_keys)) if isinstance(hard_keys, Column) else (lambda k: key_matches(k, hard_keys))
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    unlike = F.filter(common, lambda k: F.element_at(a, k) != F.element_at(b, k))
    n, c = F.size(common), F.size(unlike)
    score = F.when(n > 0, (n - c) / n).otherwise(0.0)
    return F.struct(score.alias("score"), n.alias("n_common"), c.alias("n_conflict"), F.size(F.filter(unlike, hard)).alias("n_hard"))


def candidates(offers: DataFrame, references: DataFrame, categories: DataFrame, k: int = 15) -> DataFrame:
    """offre_id, reference_id, s_semantic, rank, relaxed: for each offer the k nearest references of its brand in its category or a
    sibling of it; where its brand has none there, of its brand in all categories (relaxed).

    offers: offre_id, marque_slug, categorie_id, vector; references: reference_id and the same; categories: categorie_id,
    parent_id (null at the top). An offer without vector, or whose references have none, gets all of them, in the order of their
    ids, at a similarity of 0; a reference without vector is no candidate where another has one.
    """
    members, lists = candidate_lists(offers.select("offre_id", "marque_slug", "categorie_id", "vector"), references, categories, k)
    return members.join(lists, "list").select("offre_id", "reference_id", "s_semantic", "rank", "relaxed")


def candidate_lists(offers: DataFrame, references: DataFrame, categories: DataFrame, k: int = 15) -> tuple[DataFrame, DataFrame]:
    """candidates() in two tables: list and the columns of offers but vector, and list, reference_id, s_semantic, rank, relaxed: what offers of one vector and pool have in common, once."""
    def family(df: DataFrame) -> DataFrame:
        placed = df.join(F.broadcast(categories.select("categorie_id", "parent_id")), "categorie_id", "left")  # a row a category: by it, offers would meet in a few tasks
        return placed.withColumn("family", F.coalesce(F.concat(F.lit("p"), F.col("parent_id").cast("string")), F.concat(F.lit("c"), F.col("categorie_id").cast("string"))))

    q, r = family(offers), family(references)
    # Pools are kept, so that their size is known: few, they go to the offers, which then need not meet by pool.
    tight = F.concat_ws("\x00", F.lit("t"), "marque_slug", "family")
    loose = F.concat_ws("\x00", F.lit("l"), F.coalesce("marque_slug", F.lit("")))
    there = storage.stored(r.where("marque_slug is not null and family is not null").groupBy("marque_slug", "family").agg(F.count("vector").alias("_placed")), "pools")
    brands = storage.stored(r.groupBy(loose.alias("_loose")).agg(F.count("vector").alias("_all")), "brands")
    q = q.join(there, ["marque_slug", "family"], "left").withColumn("_loose", loose).join(brands, "_loose", "left")
    near = F.col("_placed").isNotNull()
    q = q.withColumn("group", F.when(near, tight).when(F.col("_all").isNotNull(), F.col("_loose"))).where("group is not null")
    bare = F.col("vector").isNull() | (F.when(near, F.col("_placed")).otherwise(F.col("_all")) == 0)
    q = q.withColumn("_bare", bare).drop("family", "parent_id", "_loose", "_placed", "_all").withColumnRenamed("offre_id", "query_id")
    asked = storage.stored(q.groupBy("group").agg(F.max("_bare").alias("_bare")), "asked")
    each = r.select(F.col("reference_id").alias("item_id"), "vector", F.explode(F.array(tight, loose)).alias("group"), "marque_slug", "family")
    items = each.where(F.col("group").startswith("l") | F.col("marque_slug").isNotNull() & F.col("family").isNotNull()).select("item_id", "group", "vector")
    members, lists = listed(q.where("not _bare").drop("_bare"), items.join(asked, "group", "left_semi"), k)
    named = lambda df: df.withColumn("list", F.concat_ws("\x00", "group", F.col("first").cast("string"))).drop("first")
    all_of = F.concat_ws("\x00", "group", F.lit("all")).alias("list")
    members = named(members).drop("group").unionByName(q.where("_bare").select(*(c for c in q.columns if c not in ("vector", "_bare", "group")), all_of))
    plain = items.join(asked.where("_bare"), "group", "left_semi").select("item_id", "group", all_of, F.lit(0.0).alias("similarity"))
    plain = plain.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy("item_id")))
    lists = named(lists).unionByName(plain).select("list", F.col("item_id").alias("reference_id"), F.col("similarity").alias("s_semantic"), "rank", F.col("group").startswith("l").alias("relaxed"))
    return members.withColumnRenamed("query_id", "offre_id"), lists


def matched(offers: DataFrame, references: DataFrame, categories: DataFrame, profile: Profile = COMPUTERS, weights: tuple[float, ...] = (MODEL, SPEC, SEMANTIC, NAME)) -> DataFrame:
    """decided() of the candidates of all offers: pairs are scored where offers meet the references of their list, and only the two best of an offer leave the task. Ids are long."""
    members, lists = candidate_lists(offers.select("offre_id", "marque_slug", "categorie_id", "vector", "nom", "specs", "models"), references, categories)
    lists = storage.stored(lists, "lists")
    asking = asking_side(members.withColumnRenamed("list", "key"))
    others = lists.withColumnRenamed("list", "key").join(other_side(references.select("reference_id", "nom", "specs", "models"), profile), "reference_id").withColumnRenamed("reference_id", "id")
    return decided(facts(pairs.best(asking, others, 2, scale(weights))), profile)


def scale(weights: tuple[float, ...]) -> pairs.Scale:
    return pairs.Scale(weights, SAME_MODEL, HARD_SAME, HARD_OTHER, UNLIKE, CAPACITY)


def asking_side(offers: DataFrame) -> DataFrame:
    """Offers as pairs.best() takes them: with key, and least if there is one."""
    least = F.col("least") if "least" in offers.columns else F.lit(float("-inf"))
    return offers.select(F.col("offre_id").alias("id"), "key", "nom", "specs", "models", capacities(F.col("nom")).alias("caps"), least.alias("least"))


def other_side(references: DataFrame, profile: Profile) -> DataFrame:
    """references with what pairs.best() looks at."""
    hard = F.transform(F.map_keys("specs"), lambda k: key_matches(k, profile.hard_keys))
    return references.withColumns({"caps": capacities(F.col("nom")), "hard": hard})


def facts(rows: DataFrame) -> DataFrame:
    """Rows of pairs.best() with the columns of rated(). Counts of a sheet that is null are those of a null array."""
    count = lambda c: F.when(F.col("bare"), F.size(F.lit(None).cast("array<string>"))).otherwise(F.col(c)).alias(c)
    return rows.select(
        "offre_id", "reference_id", "s_semantic", "rank", "relaxed", F.round("m", 3).alias("s_model"), F.col("m").alias("_model"),
        F.round("spec", 3).alias("s_spec"), F.round("name", 3).alias("s_name"), count("n_common"), count("n_conflict"), count("n_hard"), "score",
    )


def scored(pairs: DataFrame, offers: DataFrame, references: DataFrame, profile: Profile = COMPUTERS, weights: tuple[float, ...] = (MODEL, SPEC, SEMANTIC, NAME)) -> DataFrame:
    """pairs with s_model, s_spec, s_name, n_common, n_conflict, n_hard and score. offers and references hold nom, specs (normalised) and models.

    Where pairs have the columns of a profile_table(), these count in place of the profile.
    """
    return rated(pairs.join(side(offers, "offre_id", "a"), "offre_id").join(side(references, "reference_id", "b"), "reference_id"), pairs.columns, profile, weights)


def side(df: DataFrame, key: str, name: str, *more: str) -> DataFrame:
    """What of one side of a pair is looked at."""
    return df.select(key, *more, *(F.col(c).alias(f"{c}_{name}") for c in ("nom", "specs", "models")))


def rated(rows: DataFrame, columns: list[str], profile: Profile, weights: tuple[float, ...]) -> DataFrame:
    """scored() for pairs that have both sides with them; columns: those of the pairs."""
    rows = rows.withColumn("s_model", best_ratio("models_a", "models_b")).withColumn("s_name", token_ratio("nom_a", "nom_b")).withColumn("_spec", spec_facts(F.col("specs_a"), F.col("specs_b"), F.col("hard_phrases") if "hard_phrases" in columns else profile.hard_keys))
    m, hard = F.col("s_model"), F.col("_spec.n_hard")
    less = lambda x, by: F.greatest(F.lit(0.0), x - by)
    total = weights[0] * m + weights[1] * F.col("_spec.score") + weights[2] * F.col("s_semantic") + weights[3] * F.col("s_name")
    off = lambda each, most: F.least(hard * each, F.lit(most))
    total = F.when(hard >= 1, less(total, F.when(m >= SAME_MODEL, off(*HARD_SAME)).otherwise(off(*HARD_OTHER)))).otherwise(total)
    both = (F.size("models_a") > 0) & (F.size("models_b") > 0)
    (far, much), (wide, some) = UNLIKE
    total = F.when(both & (m < far), less(total, much)).when(both & (m < wide), less(total, some)).otherwise(total)
    a, b = capacities(F.col("nom_a")), capacities(F.col("nom_b"))
    total = F.when((m >= CAPACITY[0]) & (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), less(total, CAPACITY[1])).otherwise(total)
    return rows.select(*columns, F.round("s_model", 3).alias("s_model"), m.alias("_model"), F.round("_spec.score", 3).alias("s_spec"), F.round("s_name", 3).alias("s_name"), "_spec.n_common", "_spec.n_conflict", "_spec.n_hard", F.round(total, 4).alias("score"))


# The weights of model, specs and names, and the thresholds, of the matcher of one stage.
ONE_STAGE = (0.50, 0.35, 0.0, 0.15)
ONE_STAGE_PROFILE = Profile("une étape", COMPUTERS.hard_keys, COMPUTERS.exclude_keys, True, COMPUTERS.skip, 0.72, 0.30, 0.0, 0.0)


def one_stage(offers: DataFrame, references: DataFrame, profile: Profile = ONE_STAGE_PROFILE) -> DataFrame:
    """The older matcher: each offer against all references of its brand, without vectors, and a decision without margin. Of equal scores the smaller reference. Ids are long.

    References with a model of the offer's go first. Where the best of them is above all that one without could
    reach, it is the best of the brand; other offers are held against all references of the brand, of which those
    whose models alone keep them below that best go at once. Only an offer's best leaves the task.
    """
    a = offers.select("offre_id", "marque_slug", "nom", "specs", "models")
    b = other_side(references.select("reference_id", "marque_slug", "nom", "specs", "models"), profile)
    b = b.select(F.col("reference_id").alias("id"), "marque_slug", "nom", "specs", "models", "caps", "hard", F.lit(0.0).alias("s_semantic"), F.col("reference_id").alias("rank"), F.lit(True).alias("relaxed"))

    def best(a: DataFrame, b: DataFrame, key: Column) -> DataFrame:
        return facts(pairs.best(asking_side(a.withColumn("key", key)), b.withColumn("key", key), 1, scale(ONE_STAGE)))

    alike = lambda df: df.withColumn("_model", F.explode("models"))
    first = storage.stored(best(alike(a), alike(b), F.concat("marque_slug", F.lit("\x00"), "_model")), "first")
    # Scores have four places, so a place more than the reach is out of it.
    least = first.groupBy("offre_id").agg(F.max("score").alias("least"))
    least = storage.stored(offers.select("offre_id", unlike_reach(F.col("models")).alias("_reach")).join(least, "offre_id").select("offre_id", "least", (F.col("least") > F.col("_reach") + 0.0001).alias("_settled")), "least")
    left = a.join(least, "offre_id", "left").where("_settled is null or not _settled").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    rest = best(left, b, F.col("marque_slug"))
    return decided(first.join(least.where("_settled"), "offre_id", "left_semi").unionByName(rest), profile).drop("margin")


#: Numbers of references lie below this, a score's places above.
ABOVE, LAST = Decimal(10**20), Decimal(2**63 - 1)


def best_pairs(rows: DataFrame, profile: Profile) -> DataFrame:
    """offre_id, _best, _score: the greatest score of each offer, and of equal ones the smaller reference, in one number, which tasks keep for each offer without a sort."""
    told = rated(rows.withColumn("s_semantic", F.lit(0.0)), ["offre_id", "reference_id"], profile, ONE_STAGE)
    places = F.round(F.col("score") * 10000).cast("decimal(6,0)")
    best = told.groupBy("offre_id").agg(F.max(places * F.lit(ABOVE) + (F.lit(LAST) - F.col("reference_id").cast("decimal(19,0)"))).alias("_best"))
    return best.withColumn("_score", F.floor(F.col("_best") / F.lit(ABOVE)).cast("double") / 10000)


def unlike_reach(models: Column, weights: tuple[float, ...] = ONE_STAGE) -> Column:
    """What the score of an offer and a reference with no model in common cannot exceed: sheets and names alike, and a model that has one letter more; or a reference without any model."""
    size = F.coalesce(F.array_max(F.transform(models, F.length)), F.lit(0))
    m = 2 * size / (2 * size + 1)
    (far, much), (wide, some) = UNLIKE
    less = F.when(m < far, much).when(m < wide, some).otherwise(0.0)
    same = weights[1] + weights[3]
    return F.greatest(weights[0] * m + same - less, F.lit(float(same)))


def decided(rows: DataFrame, profile: Profile = COMPUTERS) -> DataFrame:
    """The best row of scored() for each offer, with margin (to the runner-up), layer (AUTO, REVIEW or NO_MATCH) and reason. Of equal scores the nearer goes first."""
    by = Window.partitionBy("offre_id").orderBy(F.desc("score"), "rank")
    best = rows.withColumn("_n", F.row_number().over(by)).withColumn("_second", F.lead("score", 1, 0.0).over(by)).where("_n = 1")
    best = best.withColumn("margin", F.round(F.col("score") - F.col("_second"), 4))
    bound = lambda name: F.col(f"{name}_least") if f"{name}_least" in rows.columns else F.lit(getattr(profile, name))
    below = lambda what, name: F.concat(F.lit(f"{what}<"), bound(name).cast("string"))
    high, wide = F.col("score") >= bound("auto"), F.col("margin") >= bound("margin")
    same, near = F.col("_model") >= LINKED_MODEL, F.round("s_semantic", 3) >= bound("semantic")
    layer = F.when(high & same & wide & near, "AUTO").when((F.col("score") >= bound("review")) | (high & ~wide), "REVIEW").otherwise("NO_MATCH")
    why = F.when(~same, "model<0.97").when(~wide, below("margin", "margin")).when(~near, below("semantic", "semantic"))
    best = best.withColumn("layer", layer)
    return best.withColumn("reason", F.coalesce(F.when((F.col("layer") == "REVIEW") & high, why), F.lit(""))).drop("_n", "_second", "_model")


def profile_table(spark: SparkSession, profiles: dict[str, Profile]) -> DataFrame:
    """family and what its profile asks, in columns; a row a family."""
    rows = [(f, phrases(p.hard_keys), p.auto, p.review, p.margin, p.semantic) for f, p in profiles.items()]
    return spark.createDataFrame(rows, "family string, hard_phrases array<string>, auto_least double, review_least double, margin_least double, semantic_least double")


def profiled(pairs: DataFrame, offers: DataFrame, profiles: DataFrame, default: Profile = Profile()) -> DataFrame:
    """pairs with the columns of the profile of their offer's family (offers: offre_id, family); those of default for families without one."""
    rows = pairs.join(offers.select("offre_id", "family"), "offre_id").join(F.broadcast(profiles), "family", "left")  # a row a family
    other = {"hard_phrases": F.array(*map(F.lit, phrases(default.hard_keys))), "auto_least": F.lit(default.auto), "review_least": F.lit(default.review), "margin_least": F.lit(default.margin), "semantic_least": F.lit(default.semantic)}
    return rows.drop("family").withColumns({c: F.coalesce(c, x) for c, x in other.items()})


def unmatched(offers: DataFrame, decisions: DataFrame, references: DataFrame) -> DataFrame:
    """offre_id and reason of the offers without a candidate: no_brand_in_referentiel, or no_candidate_after_prefilter."""
    left = offers.join(decisions.select("offre_id"), "offre_id", "left_anti")
    known = references.select("marque_slug").distinct().withColumn("_known", F.lit(True))
    return left.join(known, "marque_slug", "left").select("offre_id", F.when(F.col("_known"), "no_candidate_after_prefilter").otherwise("no_brand_in_referentiel").alias("reason"))


def buckets(decisions: DataFrame, family: str = "family") -> DataFrame:
    """Decisions of each layer, by family and in all (family null)."""
    count = lambda x: F.count_if(F.col("layer") == x).alias(x.lower())
    return decisions.rollup(family).agg(F.count("*").alias("total"), count("AUTO"), count("REVIEW"), count("NO_MATCH"))


def richest_sheets(references: DataFrame, offers: DataFrame) -> DataFrame:
    """references (reference_id, offre_ids, ...) with specs: the sheet with the most keys among its offers (offre_id, specs), the first in offre_ids of equals; empty without any."""
    member = references.select("reference_id", F.posexplode("offre_ids").alias("_at", "offre_id"))
    held = member.join(offers.where(F.size("specs") > 0).select("offre_id", "specs"), "offre_id")
    best = held.groupBy("reference_id").agg(F.max_by("specs", F.struct(F.size("specs"), -F.col("_at"))).alias("specs"))
    out = references.join(best, "reference_id", "left")
    return out.withColumn("specs", F.coalesce("specs", F.create_map().cast(T.MapType(T.StringType(), T.StringType()))))


#: Keys of a sheet that an embedded text tells, at most.
TEXT_KEYS = 8


def embedding_text(name: Column, brand: Column, specs: Column, hard_keys: tuple[str, ...], most: int = TEXT_KEYS) -> Column:
    """name | brand | key=value ...: the first hard keys of a sheet that have a value, in the sheet's order, normalised."""
    entries = F.filter(F.map_entries(F.coalesce(specs, F.create_map().cast("map<string,string>"))), lambda e: key_matches(e["key"], hard_keys))
    told = F.filter(F.transform(entries, lambda e: F.struct(normalize_key(e["key"]).alias("k"), normalize_value(e["key"], e["value"]).alias("v"))), lambda e: e["v"] != "")
    text = F.array_join(F.transform(F.slice(told, 1, most), lambda e: F.concat(e["k"], F.lit("="), e["v"])), " ")
    return F.btrim(F.concat(F.btrim(F.coalesce(name, F.lit(""))), F.lit(" | "), F.btrim(F.coalesce(brand, F.lit(""))), F.lit(" | "), text))


# The signals of a comment that are shown, and their names.
CRITERIA = (("s_model", "model"), ("s_spec", "spec"), ("s_name", "name"))


def criteria(candidates: DataFrame, key: str) -> DataFrame:
    """key, critere, score, detail, justification: a row for each signal in a candidate's JSON comment (commentaire); none for one that cannot be read. detail: the models of both sides."""
    data = F.when(F.get_json_object("commentaire", "$").isNotNull(), F.col("commentaire"))
    field = lambda name: F.get_json_object(data, f"$.{name}")
    names = lambda c: F.coalesce(F.concat(F.lit("['"), F.array_join(F.from_json(field(c), "array<string>"), "', '"), F.lit("']")), F.lit("None"))
    detail = F.when(field("offer_models").isNotNull() | field("ref_models").isNotNull(), F.concat(F.lit("offer="), names("offer_models"), F.lit(" ref="), names("ref_models")))
    each = F.array(*(F.struct(F.lit(label).alias("critere"), field(name).try_cast("double").alias("score"), (detail if label == "model" else F.lit(None).cast("string")).alias("detail")) for name, label in CRITERIA))
    return candidates.select(key, F.explode(each).alias("_c"), field("justification").alias("justification")).where("_c.score is not null").select(key, "_c.*", "justification")
