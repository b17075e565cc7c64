"""Spec sheets made comparable: keys, values, model codes and capacities, of built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, one_for_each
from .text import normalize_key, slug

# Phrases that mark a spec key as one of a profile's keys.
SYNONYMS = {
    "ram": ("ram", "memoire vive", "memoire"),
    "stockage": ("stockage", "disque dur", "disque", "ssd", "hdd", "capacite de stockage"),
    "type_stockage": ("type de disque", "type de stockage", "type stockage"),
    "processeur": ("processeur", "cpu"),
    "carte_graphique": ("carte graphique", "gpu", "chipset graphique", "carte video"),
    "gpu": ("gpu", "carte graphique"),
    "vram": ("vram", "memoire video", "memoire dediee", "memoire graphique"),
    "taille_ecran": ("taille de l ecran", "taille ecran", "ecran", "diagonale", "pouce"),
    "resolution": ("resolution",),
    "frequence": ("frequence", "frequence d horloge"),
    "capacite_batterie": ("capacite batterie", "batterie", "autonomie"),
    "classe_energetique": ("classe energetique", "efficacite energetique"),
    "nombre_couverts": ("nombre de couverts", "couverts"),
    "norme_wifi": ("norme wifi", "norme", "wifi"),
    "nombre_ports": ("nombre de ports", "ports"),
}
# Names of resolutions, and values that say nothing.
RESOLUTIONS = {"full hd": "1920x1080", "fhd": "1920x1080", "hd ready": "1366x768", "wqhd": "2560x1440", "qhd": "2560x1440", "2k": "2560x1440", "uhd": "3840x2160", "4k": "3840x2160", "ultra hd": "3840x2160"}
GENERIC = ("autres", "autre", "n/a", "na", "—", "-", "non défini", "non defini", "non spécifié", "non specifie", "standard", "divers", "")
# Words in names that look like model codes, and the beginnings of processor codes.
NOT_MODELS = ("USB", "USB2", "USB3", "USB4", "HDMI", "HDMI2", "RGB", "ARGB", "LED", "OLED", "AMOLED", "FHD", "UHD", "QHD", "WQHD", "WFHD", "WUXGA", "UWQHD", "IPS", "TFT", "TN", "VA", "MVA", "SSD", "HDD", "SSHD", "NVME", "DDR3", "DDR4", "DDR5", "PCIe", "PCIE", "WIFI", "WIFI6", "LAN", "NFC", "OTG", "AC", "DC", "DP", "DVI", "VGA", "4G", "5G", "3G", "GEN3", "GEN4", "GEN5")
PROCESSOR = r"^(intel|amd|ryzen|coreultra|corei\d|corei|core\d|i[3579]|celeron|pentium|athlon|xeon|snapdragon|rtx|gtx|rx\d|radeon|geforce)"
# Patterns of a capacity and of a model code in a name.
CAPACITY = r"(?i)\b(\d+(?:\.\d+)?\s*(?:go|gb|to|tb|mo|mb))\b"
CODE = r"\b([A-Z][A-Z0-9\-]*\d[A-Z0-9\-]*)\b"
MODEL_KEYS = ("Modèle", "modèle", "Modele", "modele", "Model", "model")


def key_matches(key: Column, wanted: Iterable[str]) -> Column:
    """Whether a spec key holds, as text or as a set of words, a phrase of one of the wanted keys. An empty key matches none."""
    told = phrases(wanted)

    def held(x: Column) -> Column:
        found = F.lit(False)
        for phrase in told:
            words = F.array(*(F.lit(w) for w in phrase.split()))
            found = found | F.contains(x["bare"], F.lit(phrase)) | (F.size(F.array_except(words, x["words"])) == 0)
        return (x["bare"] != "") & found

    # The key is normalised once for all phrases: within a lambda nothing else would see to that.
    return let(let(normalize_key(key), lambda bare: F.struct(bare.alias("bare"), F.split(bare, " ").alias("words"))), held)


def phrases(wanted: Iterable[str]) -> list[str]:
    """The normalised phrases that mark a key as one of the wanted ones."""
    return list(dict.fromkeys(p for w in wanted for p in SYNONYMS.get(w, (w.replace("_", " "),))))


def key_matches_any(key: Column, told: Column) -> Column:
    """key_matches() for an array of phrases in a column."""
    bare = normalize_key(key)
    return (bare != "") & F.exists(told, lambda p: F.contains(bare, p) | (F.size(F.array_except(F.split(p, " "), F.split(bare, " "))) == 0))


def number(x: Column) -> Column:
    """A number's text: whole ones bare, others with up to six digits and no zeros at the end."""
    def of(x: Column) -> Column:
        digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-300)))).cast("int"))
        short = let(F.pow(F.lit(10.0), digits), lambda scale: F.call_function("format_number", F.round(x * scale) / scale, F.lit("0.##########")))
        return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(short)

    return let(x, of)


def normalize_value(key: Column, value: Column) -> Column:
    """A spec's value in one spelling: resolution, storage, frequency, screen size, else its lower-case text. Null gives an empty text.

    They are tried in this order; 1000 GB are 1 TB, 1000 MB 1 GB, 1000 MHz 1 GHz. A bare number of 4 to 120 under a screen's key is in inches.
    """
    bare = F.lower(F.btrim(F.coalesce(value, F.lit(""))))
    bare = F.btrim(F.regexp_replace(F.regexp_replace(bare, r"(\d),(\d)", "$1.$2"), r"\s+", " "))
    screen = F.rlike(F.lower(F.coalesce(key, F.lit(""))), F.lit(SCREEN))
    return let(bare, lambda s: spelt(s, screen))


# Patterns of sizes in a value, in the order in which they are tried, of a screen's key, and of watts.
WIDE = r"(\d+)\s*[x×]\s*(\d+)"
STORE = r"(?i)(\d+(?:\.\d+)?)\s*(go|gb|to|tb|mo|mb)\b"
CLOCK = r"(?i)(\d+(?:\.\d+)?)\s*(ghz|mhz)\b"
INCH = r"(?i)(\d+(?:\.\d+)?)\s*(?:pouces?\b|inch(?:es)?\b|in\b|\"|'')"
SCREEN = "ecran|pouce|diagonal|taille.?ecran|screen|display"
WATTS = r"(\d+(?:\.\d+)?)\s*watts?\b"


def spelt(s: Column, screen: Column) -> Column:
    """A value that is trimmed and in lower case in its one spelling; screen: whether its key is a screen's."""
    part = lambda pattern, i: F.regexp_extract(s, pattern, i)
    figure = lambda pattern: part(pattern, 1).try_cast("double")
    whole = lambda i: part(WIDE, i).cast("decimal(38,0)").cast("string")

    def stored(x: Column) -> Column:
        even = (x["size"] >= 1000) & (x["size"] % 1000 == 0)
        kilo = lambda unit: F.concat(number(x["size"] / 1000), F.lit(unit))
        return F.when((x["unit"] == "gb") & even, kilo("tb")).when((x["unit"] == "mb") & even, kilo("gb")).otherwise(F.concat(number(x["size"]), x["unit"]))

    def clocked(x: Column) -> Column:
        return F.when((x["unit"] == "mhz") & (x["size"] >= 1000), F.concat(number(x["size"] / 1000), F.lit("ghz"))).otherwise(F.concat(number(x["size"]), x["unit"]))

    sized = lambda pattern, unit: F.struct(figure(pattern).alias("size"), unit.alias("unit"))
    names = F.create_map(*(F.lit(x) for pair in RESOLUTIONS.items() for x in pair))
    bare = s.try_cast("double")
    return (
        F.when(s == "", "")
        .when(F.map_contains_key(names, s), F.element_at(names, s))
        .when(s.rlike(WIDE), F.concat(whole(1), F.lit("x"), whole(2)))
        .when(s.rlike(STORE), let(sized(STORE, F.replace(F.lower(part(STORE, 2)), F.lit("o"), F.lit("b"))), stored))
        .when(s.rlike(CLOCK), let(sized(CLOCK, part(CLOCK, 2)), clocked))
        .when(s.rlike(INCH), F.concat(number(figure(INCH)), F.lit("in")))
        .when(screen & bare.between(4.0, 120.0), F.concat(number(bare), F.lit("in")))
        .otherwise(F.btrim(F.regexp_replace(s, WATTS, "$1w")))
    )


# What the older matcher folds: units of storage, watts, inches, and names of no system.
OLD_UNITS = (("go", "gb"), ("to", "tb"), ("mo", "mb"))
NO_SYSTEM = r"(?i)free[\s_\-]?dos|sans\s+os\b|no\s+os\b"


def old_value(value: Column) -> Column:
    """A spec's value as the older matcher spells it. Null gives an empty text."""
    v = F.lower(F.btrim(F.coalesce(value, F.lit(""))))
    for unit, name in (*OLD_UNITS, *((n, n) for _, n in OLD_UNITS)):
        v = F.regexp_replace(v, rf"(\d+(?:\.\d+)?)\s*{unit}\b", f"$1{name}")
    v = F.regexp_replace(F.regexp_replace(v, r"(\d+(?:\.\d+)?)\s*watts?\b", "$1w"), r"(\d+(?:\.\d+)?)\s*(?:pouces?|inch(?:es)?)\b", '$1"')
    return F.btrim(F.regexp_replace(F.regexp_replace(v, NO_SYSTEM, "freedos"), r"(\d+)\.0\b", "$1"))


def normalize_specs(specs: Column, exclude: Iterable[str]) -> Column:
    """A sheet (a map) with normalised keys and values, without excluded keys and values that say nothing. Of keys that become one, the last wins."""
    exclude = tuple(exclude)
    entries = F.transform(F.map_entries(F.coalesce(specs, F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("raw"), normalize_key(e["key"]).alias("key"), normalize_value(e["key"], e["value"]).alias("value")))
    kept = F.filter(entries, lambda e: ~key_matches(e["raw"], exclude) & ~e["value"].isin(*GENERIC))
    return F.map_from_entries(F.transform(one_for_each(kept, "key", last=True), lambda e: F.struct(e["key"], e["value"])))


def model_slug(text: Column) -> Column:
    """Letters a-z and digits of a model's code, storage units in one spelling; empty for eight or more digits alone."""
    one = text
    for units, name in (("go|gb", "gb"), ("to|tb", "tb"), ("mo|mb", "mb")):
        one = F.regexp_replace(one, rf"(?i)(\d+(?:\.\d+)?)\s*(?:{units})\b", f"$1{name}")
    bare = slug(one)
    return F.when(bare.rlike(r"^\d{8,}$"), "").otherwise(bare)


def model_slugs(specs: Column, name: Column, from_name: bool = False, skip: Iterable[str] = ()) -> Column:
    """The distinct model codes of an offer: that of its article number, that of its sheet's model, and, if there is neither and
    from_name is set, those of its name. Processors' codes are none."""
    held = lambda keys: F.coalesce(*(F.nullif(F.element_at(specs, F.lit(k)), F.lit("")) for k in keys))
    good = lambda x: x.isNotNull() & (x != "") & ~x.rlike(PROCESSOR)
    told = F.filter(F.array(model_slug(held(("gtin", "GTIN"))), model_slug(held(MODEL_KEYS))), good)
    if from_name:
        words = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(CODE), F.lit(1))
        codes = F.transform(F.filter(words, lambda x: ~x.isin(*NOT_MODELS, *(w.upper() for w in skip))), model_slug)
        told = F.when(F.size(told) > 0, told).otherwise(F.filter(codes, lambda x: good(x) & (F.length(x) >= 2)))
    return F.array_distinct(told)


def capacities(name: Column) -> Column:
    """The distinct capacities in a name, in one spelling."""
    found = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(CAPACITY), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: normalize_value(F.lit("capacite"), x)))


def canonical_json(specs: Column) -> Column:
    """A sheet as JSON with trimmed lower-case keys and values, by key, without null values."""
    entries = F.filter(F.map_entries(specs), lambda e: e["value"].isNotNull())
    bare = F.array_sort(F.transform(entries, lambda e: F.struct(F.lower(F.btrim(e["key"])).alias("key"), F.lower(F.btrim(e["value"])).alias("value"))))
    return F.to_json(F.map_from_entries(bare))
