"""Texts for people: messages of events, ages, deltas, answers of a judge, routes of a question."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

# A message for each event type, and for others.
MESSAGES = {
    S.PRICE_DROP: "{site} a baissé un produit",
    S.PRICE_RISE: "Hausse de prix détectée sur {site}",
    S.PROMO_START: "Promotion détectée sur {site}",
    S.OUT_OF_STOCK: "Rupture détectée sur {site}",
    S.BACK_IN_STOCK: "Retour en stock sur {site}",
    S.NEW_OFFER: "Nouveau produit sur {site}",
}
OTHER_MESSAGE = "Événement sur {site}"
# The short names of months.
MONTHS = ("janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc.")
# Patterns of a greeting, of a question on a document, and of a route's name.
GREETING = r"^(bonjour|salut|hello|merci|bonsoir|hey|ok)\b"
DOCUMENT = (
    r"\b(document|fichier|upload[eé]|pdf|le\s+doc|rapport\s+upload[eé]|"
    r"rapport\s+annuel|rapport\s+\d{4}|contenu\s+du\s+rapport|"
    r"selon\s+le\s+rapport|d['\s]apr[eè]s\s+le|que\s+dit\s+le|"
    r"dans\s+le\s+document|r[eé]sum[eé].*rapport|analyser\s+le\s+rapport)\b"
)
ROUTE = r"\b(DIRECT|DB_TOOLS|DOCUMENTS|HYBRID)\b"


def event_message(kind: Column, site: Column) -> Column:
    """The message of an event; a general one for a type without its own."""
    def told(text: str) -> Column:
        before, after = text.split("{site}")
        return F.concat(F.lit(before), site, F.lit(after))

    out = told(OTHER_MESSAGE)
    for name, text in MESSAGES.items():
        out = F.when(kind == name, told(text)).otherwise(out)
    return out


def age(at: Column, now: Column) -> Column:
    """How long ago a moment was, in words: minutes, hours, days, from a week on the day and the short name of the month."""
    s = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))
    ago = lambda n, unit: F.concat(F.lit("il y a "), F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(at.isNull(), "—").when(s < 60, "à l'instant").when(s < 3600, ago(60, " min")).when(s < 86400, ago(3600, "h")).when(s < 7 * 86400, ago(86400, "j")).otherwise(F.concat(F.dayofmonth(at).cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(at))))


def day_delta(delta: Column, total: Column) -> Column:
    """A day's change in words, with its share of what was before if it rose; halves go up."""
    share = F.floor(delta / F.greatest(F.lit(1), total - delta) * 100 + 0.5).cast("long").cast("string")
    rise = F.concat(F.lit("↑ "), delta.cast("string"), F.lit(" vs hier (+"), share, F.lit("%)"))
    return F.when(F.coalesce(delta, F.lit(0)) == 0, "Stable vs hier").when(delta > 0, rise).otherwise(F.concat(F.lit("↓ "), F.abs(delta).cast("string"), F.lit(" vs hier")))


def next_run(last: Column, now: Column) -> Column:
    """A day after the last run; where that has passed, a day from now; null without a run."""
    day = F.expr("INTERVAL 24 HOURS")
    return F.when(last + day < now, now + day).otherwise(last + day)


def percent(part: Column, whole: Column, digits: int = 0) -> Column:
    """part of whole in percent, 0 for an empty whole."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), digits), F.lit(0.0))


def judged(answer: Column) -> Column:
    """decision and justification in a judge's answer: the word after DECISION: if it is OUI, NON or INCERTAIN, else INCERTAIN with the whole answer."""
    text = F.btrim(answer)
    rest = F.btrim(F.regexp_extract(text, r"(?s)DECISION:(.*)$", 1))
    word = F.upper(F.regexp_extract(rest, "(?i)^(OUI|NON|INCERTAIN)", 1))
    told = F.btrim(F.regexp_replace(F.substring(rest, F.length(word) + 1, F.length(rest)), "^[ —:-]+", ""))
    return F.struct(F.when(word != "", word).otherwise("INCERTAIN").alias("decision"), F.when(word != "", told).otherwise(text).alias("justification"))


def route(question: Column, answer: Column) -> Column:
    """Where a question goes: short greetings DIRECT, questions on a document DOCUMENTS, else the route named in a classifier's answer, DB_TOOLS without one."""
    greeting = (F.length(question) < 20) & F.btrim(question).rlike("(?i)" + GREETING)
    document = question.rlike("(?iU)" + DOCUMENT)
    named = F.regexp_extract(F.upper(F.coalesce(answer, F.lit(""))), ROUTE, 1)
    return F.when(greeting, "DIRECT").when(document, "DOCUMENTS").otherwise(F.coalesce(F.nullif(named, F.lit("")), F.lit("DB_TOOLS")))


def fact_kind(text: Column, kinds: Iterable[tuple[str, tuple[str, ...]]], other: str = "context") -> Column:
    """The first kind of which a fact holds a word, in any case."""
    low, out = F.lower(text), F.lit(other)
    for kind, held in reversed(list(kinds)):
        found = F.lit(False)
        for w in held:
            found = found | F.contains(low, F.lit(w))
        out = F.when(found, kind).otherwise(out)
    return out


def known_fact(new: Column, old: Column) -> Column:
    """Whether one of the old facts (an array) holds half, and at least one, of the long words of a new one. A fact without long words is never known."""
    words = F.array_distinct(F.filter(F.split(F.lower(new), r"\s+"), lambda w: F.length(w) > 5))
    enough = F.greatest(F.lit(1), F.floor(F.size(words) / 2))
    return (F.size(words) > 0) & F.exists(old, lambda o: F.size(F.filter(words, lambda w: F.contains(o, w))) >= enough)
