"""Column functions on written cases."""

import pytest
from pyspark.sql import functions as F

from pricelens.functions import prices, text


def applied(spark, function, cases, kinds):
    names = [f"c{i}" for i in range(len(kinds))]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)) + ", i int"
    rows = [(*(c if isinstance(c, tuple) else (c,)), i) for i, c in enumerate(cases)]
    out = spark.createDataFrame(rows, schema).select("i", function(*map(F.col, names)).alias("out"))
    return [r.out for r in sorted(out.collect(), key=lambda r: r.i)]


CASES = [
    (prices.parse_price, ["string"], {"1.234,99 TND": 1234.99, "1\u00a0234,500 dt": 1234.5, "99.9 DT TTC": 99.9, "1.234.5": 1.234, "1,2,3": 1.23, "": None, "sur demande": None, ".": None, None: None}),
    (prices.parse_plain_price, ["string"], {"12,5 DT": 12.5, "7.25": 7.25, "rien": None, None: None}),
    (prices.join_price, ["string", "string"], {("1 2", "5 DT"): 12.5, ("7", None): 7.0, ("7", ""): 7.0, ("", "5"): 0.5, (None, "5"): None}),
    (lambda o, f: F.array(*prices.promotion(o, f)), ["double", "double"], {(10.0, 8.0): [10.0, 8.0], (8.0, 8.0): [8.0, None], (None, 8.0): [8.0, None], (10.0, None): [None, None]}),
    (prices.original_before, ["double", "double"], {(80.0, 20.0): 100.0, (80.0, 100.0): None, (None, 5.0): None}),
    (prices.discount_percent, ["double", "double"], {(100.0, 75.0): 25, (0.0, 1.0): None, (None, 1.0): None}),
    (prices.intensity, ["long", "long"], {(1, 4): 2, (3, 20): 2, (9, 2): 10, (3, 0): 10, (0, None): 0}),
    (text.clean, ["string"], {"  a b  ": "a b", " ": None, None: None}),
    (text.normalize_key, ["string"], {"Taille de l'Écran_2": "taille de l ecran 2", "--": "", None: ""}),
    (text.slug, ["string"], {"A-b 1é": "ab1", None: ""}),
    (text.page_number, ["string"], {"x?page=3": 3, "x?a=1&p=12": 12, "x?top=4": 1, "x": 1, None: 1}),
    (text.without_query, ["string"], {"x?a?b": "x", "x": "x", None: None}),
    (text.cited_sources, ["string"], {"[Source: a] [source:b ] [Source: a]": ["a", "b"], "none": [], None: []}),
]


@pytest.mark.parametrize("function, kinds, cases", CASES, ids=[str(i) for i in range(len(CASES))])
def test_function(spark, function, kinds, cases):
    assert applied(spark, function, list(cases), kinds) == list(cases.values())
