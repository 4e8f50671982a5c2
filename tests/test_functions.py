"""Spans, trailing ranges, scalar rules and exact percentiles."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoplight.functions.quantiles import exact_percentile
from shoplight.functions.scalars import event_time, funnel_position, or_default, page_category, percent
from shoplight.functions.stems import same_stem, stem
from shoplight.functions.times import parse_span, seconds_between, span, trailing


@pytest.mark.parametrize("text", ["", "7", "DAY", "7 DAYS", "-7 DAY", "7 DAY; DROP TABLE x", "7  DAY", "1.5 HOUR", "7 DAY)"])
def test_spans_are_strict(text):
    with pytest.raises(ValueError):
        parse_span(text)


@given(st.integers(0, 999999), st.sampled_from(["MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "YEAR"]))
def test_spans_parse(n, unit):
    assert parse_span(f"{n} {unit.lower()}") == (n, unit)


def test_trailing_includes_its_bound(spark):
    at = dt.datetime(2024, 3, 31, 12)
    rows = [(dt.datetime(2024, 2, 29, 12),), (dt.datetime(2024, 2, 29, 11, 59, 59),), (at,)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    assert trailing(df, "t", "1 MONTH", at).count() == 2
    assert trailing(df, "t", "1 MONTH").count() == 2
    assert trailing(df, "t", "1 HOUR").count() == 1
    assert trailing(df.limit(0), "t", "1 HOUR").count() == 0


def test_week_is_seven_days(spark):
    row = spark.range(1).select((F.lit(dt.datetime(2024, 1, 8)) - span("1 WEEK")).cast("string").alias("t")).first()
    assert row.t == "2024-01-01 00:00:00"


def test_seconds_are_cut(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, 0, 0, 999999), dt.datetime(2024, 1, 1, 0, 0, 2, 999998))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    assert df.select(seconds_between(F.col("a"), F.col("b"))).first()[0] == 1


def test_percent_of_nothing_is_null(spark):
    df = spark.createDataFrame([(1, 3), (1, 0)], "a int, b int")
    assert [r[0] for r in df.select(percent(F.col("a"), F.col("b"))).collect()] == [33.33, None]


def test_empty_values_take_the_default(spark):
    df = spark.createDataFrame([(0, ""), (None, None), (5, "x")], "n int, s string")
    rows = df.select(or_default(F.col("n"), 0, 9), or_default(F.col("s"), "", "none")).collect()
    assert [tuple(r) for r in rows] == [(9, "none"), (9, "none"), (5, "x")]


def test_page_category_order(spark):
    paths = ["/", "/index.html", "/shop-contact", "/product-details?x", "/contact-us", "/about", "/shop/index.html"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    found = [r[0] for r in df.select(page_category(F.col("p"))).collect()]
    assert found == ["homepage", "homepage", "shop", "product", "contact", "other", "shop"]


def test_funnel_position(spark):
    df = spark.createDataFrame([("purchase",), ("view",), ("refund",), ("checkout",), ("add_to_cart",), (None,)], "s string")
    assert [r[0] for r in df.select(funnel_position(F.col("s"))).collect()] == [4, 1, 5, 3, 2, 5]


def test_event_time(spark):
    df = spark.createDataFrame(
        [("2025-01-15T10:00:00.987Z",), ("2025-01-15 10:00:00",), (None,), ("yesterday",)], "t string"
    )
    now = dt.datetime(2030, 1, 1, 0, 0, 0, 5)
    found = [r[0] for r in df.select(event_time(F.col("t"), F.lit(now)).cast("string")).collect()]
    assert found == ["2025-01-15 10:00:00", "2025-01-15 10:00:00", "2030-01-01 00:00:00", "2030-01-01 00:00:00"]


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_exact_percentile(spark, q):
    """Groups over several ranges, one of them with a third of all rows, one with few values, one without a name."""
    rng = np.random.default_rng(7)
    groups = {"hot": rng.lognormal(3, 2, 6000), "few": rng.integers(0, 4, 5000).astype(float),
              "flat": rng.random(5000), "tiny": rng.random(3), "one": np.array([4.0]), "same": np.full(5000, 2.5), None: rng.random(700)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("few", None)] * 50
    df = spark.createDataFrame(rows, "g string, x double").repartition(8)
    found = {r.g: r.percentile for r in exact_percentile(df, ["g"], "x", q).collect()}
    for g, xs in groups.items():
        assert found[g] == pytest.approx(np.quantile(xs, q), rel=1e-12), g


# Words and stems as the algorithm's publication gives them.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll games game racing race puzzles puzzl generalizations gener oscillators oscil toy toi by by syzygy syzygi""".split()


def test_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2]))
    words = spark.createDataFrame([*pairs, ("naïve", "naïve"), ("42nds", "42nds"), ("", ""), (None, None)], "word string, stem string")
    wrong = words.filter(~stem(F.col("word")).eqNullSafe(F.col("stem")))
    assert wrong.collect() == []
    assert words.filter("stem <> ''").filter(~same_stem(F.col("word"), F.col("stem"))).collect() == []
