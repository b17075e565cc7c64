"""Texts for people against hand-written cases."""

import datetime as dt

from pyspark.sql import functions as F

from pricelens.functions import labels


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).head())


def test_labels(spark):
    now = dt.datetime(2024, 5, 10, 12)
    back = lambda **k: labels.age(F.lit(now - dt.timedelta(**k)), F.lit(now))
    assert one(spark, back(seconds=5), back(minutes=61), back(days=3), back(minutes=7), back(days=9), labels.age(F.lit(None).cast("timestamp"), F.lit(now))) == ("à l'instant", "il y a 1h", "il y a 3j", "il y a 7 min", "1 mai", "—")
    assert one(spark, *(labels.day_delta(F.lit(a), F.lit(b)) for a, b in ((0, 9), (3, 9), (-2, 9), (4, 4)))) == ("Stable vs hier", "↑ 3 vs hier (+50%)", "↓ 2 vs hier", "↑ 4 vs hier (+400%)")
    told = [tuple(x) for x in one(spark, *(labels.judged(F.lit(x)) for x in ("blah DECISION: oui — même modèle", "DECISION: peut-être", "rien", "DECISION:NON")))]
    assert told == [("OUI", "même modèle"), ("INCERTAIN", "DECISION: peut-être"), ("INCERTAIN", "rien"), ("NON", "")]
    assert one(spark, labels.event_message(F.lit("AUTRE"), F.lit("s")), labels.event_message(F.lit(None).cast("string"), F.lit("s"))) == ("Événement sur s",) * 2
    assert one(spark, labels.route(F.lit("Cherche dans le document"), F.lit(None))) == ("DOCUMENTS",)
    ways = one(spark, *(labels.route(F.lit(q), F.lit(a)) for q, a in (("Bonjour !", None), ("bonjour, quels sont les prix ?", "route: hybrid"), ("Que dit le rapport 2024 ?", None), ("prix", None))))
    assert ways == ("DIRECT", "HYBRID", "DOCUMENTS", "DB_TOOLS")
    kinds = (("product", ("produit", "marque")), ("preference", ("format",)))
    assert one(spark, *(labels.fact_kind(F.lit(x), kinds) for x in ("Aime la Marque X", "format court", "autre"))) == ("product", "preference", "context")
    old = F.array(F.lit("suit les smartphones samsung"))
    assert one(spark, *(labels.known_fact(F.lit(x), old) for x in ("surveille smartphones samsung", "rien", "regarde téléviseurs"))) == (True, False, False)
    assert one(spark, labels.percent(F.lit(1), F.lit(3)), labels.percent(F.lit(1), F.lit(0)), labels.next_run(F.lit(now), F.lit(now + dt.timedelta(hours=30)))) == (33.0, 0.0, now + dt.timedelta(hours=54))
