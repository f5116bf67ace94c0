"""Reading dirty values, rounding and exact sums."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from opslens.functions.coerce import double_text, is_blank, is_delayed, is_truthy, label, to_number
from opslens.functions.dates import DateReading, elect_dates, layout_facts, to_ts
from opslens.functions.numbers import fixed, money_sum, money_text, percent_text, rounded
from opslens.functions.quantile import exact_quantile, order_key


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def results(df, expression):
    return [r.y for r in df.select("i", expression.alias("y")).orderBy("i").collect()]


def test_numbers_from_text(spark):
    good = {"12": 12.0, " 12 ": 12.0, "1e3": 1000.0, "+3": 3.0, ".5": 0.5, "5.": 5.0, "1E+2": 100.0, "inf": math.inf,
            "-Infinity": -math.inf, "-7.25": -7.25}
    bad = ["1,000", "$5", "nan", "", "0x10", "1_000", "True", "1d", "1f", "2D", "1 2", None]
    assert results(column(spark, list(good)), to_number(F.col("x"))) == list(good.values())
    assert results(column(spark, bad), to_number(F.col("x"))) == [None] * len(bad)


def test_numbers_from_numbers(spark):
    df = column(spark, [1.5, float("nan"), None], "double")
    assert results(df, to_number(F.col("x"), T.DoubleType())) == [1.5, None, None]
    assert results(column(spark, [True, False], "boolean"), to_number(F.col("x"), T.BooleanType())) == [1.0, 0.0]


DATES = {
    "2026-01-05": "2026-01-05 00:00:00", "01/06/2026": "2026-01-06 00:00:00", "20260107": "2026-01-07 00:00:00",
    "Jan 8, 2026": "2026-01-08 00:00:00", "2026-01-05T10:00:00Z": "2026-01-05 10:00:00",
    "2026-01-05T10:00:00+02:00": "2026-01-05 08:00:00", "January 8, 2026": "2026-01-08 00:00:00",
    "8 Jan 2026": "2026-01-08 00:00:00", "8-March-2026": "2026-03-08 00:00:00", "2026/1/5 10:30": "2026-01-05 10:30:00",
    "1/5/2026 10:30:05": "2026-01-05 10:30:05", "1-5-2026": "2026-01-05 00:00:00", " 2026-01-05 ": "2026-01-05 00:00:00",
    "2026-02-30": None, "13/02/2026": None, "10:00": None, "2026": None, "": None, "not-a-date": None, None: None,
    "Marx 5, 2026": None, "1/5-2026": None, "later\n2026-01-05": None,
}


def test_dates(spark):
    df = column(spark, list(DATES))
    assert results(df, to_ts(F.col("x")).cast("string")) == list(DATES.values())


def test_dates_in_one_layout(spark):
    df = column(spark, ["2026-01-05", "01/06/2026"])
    assert results(df, to_ts(F.col("x"), reading="iso").cast("string")) == ["2026-01-05 00:00:00", None]


def test_dates_from_whole_numbers(spark):
    assert results(column(spark, [20260107, 7], "bigint"), to_ts(F.col("x"), T.LongType()).cast("string")) == [
        "2026-01-07 00:00:00", None]


def test_flags(spark):
    df = column(spark, ["1", "TRUE", "Yes", "y", " yes", "1.0", "t", None])
    assert results(df, is_truthy(F.col("x"))) == [True] * 4 + [False] * 4
    assert results(column(spark, [True, None], "boolean"), is_truthy(F.col("x"))) == [True, False]


def test_delay_words(spark):
    df = column(spark, ["Late", "EXCEPTION", "delayed", "Plate", "Delivered", None])
    assert results(df, is_delayed(F.col("x"))) == [True] * 4 + [False] * 2


def test_blank(spark):
    df = column(spark, [None, "", " ", "\t\n", " ", "a", " a "])
    assert results(df, is_blank(F.col("x"))) == [True] * 5 + [False] * 2


def test_labels_and_text_of_doubles(spark):
    assert results(column(spark, ["a", None]), label(F.col("x"))) == ["a", "nan"]
    values = [5.0, 153.33, 1e7, 12345678.5, 4155551234.0, 0.0001, 0.00012345, 1e15, 0.1, -2.5e9]
    assert results(column(spark, values, "double"), double_text(F.col("x"))) == [repr(v) for v in values]


@pytest.mark.parametrize("places", [1, 2, 4])
def test_rounding_follows_the_exact_binary_value(spark, places):
    rng = random.Random(places)
    values = [2.675, 0.125, 1.005, 0.5, 2.5, 5e-5, 5e-2, 5e-3, -5e-5, -2.675, 0.0, 1e16, math.inf]
    values += [k / 6000 for k in range(6000)] + [k / 200 for k in range(2000)]
    values += [rng.uniform(-1e9, 1e9) for _ in range(2000)]
    found = results(column(spark, values, "double"), rounded(F.col("x"), places))
    assert found == [v if math.isinf(v) else round(v, places) for v in values]


def test_display(spark):
    df = column(spark, [1234.5, 0.0, None, 1234567.885], "double")
    assert results(df, money_text(F.col("x"))) == ["$1,234", "$0", "—", "$1,234,568"]
    assert results(df, fixed(F.col("x"), 2)) == ["1,234.50", "0.00", None, f"{1234567.885:,.2f}"]
    assert results(column(spark, [0.1234, None], "double"), percent_text(F.col("x"))) == ["12.3%", "—"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-10**11, 10**11), max_size=60))
def test_money_sum_is_exact(spark, cents):
    values = [c / 100 for c in cents]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    assert df.agg(money_sum(F.col("x")).alias("s")).first().s == sum(cents) / 100


def test_money_sum_of_large_amounts(spark):
    df = column(spark, [1e20, 1.5, None], "double")
    assert df.agg(money_sum(F.col("x")).alias("s")).first().s == 1e20
    assert column(spark, [math.inf, 1.0], "double").agg(money_sum(F.col("x")).alias("s")).first().s == math.inf


def test_money_sum_refuses_what_it_cannot_hold(spark):
    with pytest.raises(Exception, match="amount out of range"):
        column(spark, [1e22, 1.0], "double").agg(money_sum(F.col("x")).alias("s")).first()
    assert column(spark, [1e-11, 1e-11], "double").agg(money_sum(F.col("x")).alias("s")).first().s == 2e-11


def quantiles(spark, frame, p, by):
    df = spark.createDataFrame(frame)
    counts = df.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    return exact_quantile(counts, "v", p, by).toPandas()


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 100, 101, 4000])
@pytest.mark.parametrize("p", [0.75, 0.1])
def test_quantile_of_all_rows(spark, size, p):
    rng = np.random.default_rng(size)
    for values in (rng.integers(0, 30, size).astype(float), rng.normal(size=size)):
        found = quantiles(spark, pd.DataFrame({"v": values}), p, [])
        assert found["quantile"][0] == pytest.approx(pd.Series(values).quantile(p), abs=0, rel=1e-15)


def test_quantile_per_group_beyond_the_sketch(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"g": rng.choice(["hot", "warm", None], 90_000, p=[0.7, 0.2, 0.1]), "v": rng.normal(size=90_000)})
    found = quantiles(spark, frame, 0.75, ["g"])
    expected = frame.groupby("g", dropna=False)["v"].quantile(0.75)
    assert {r.g if isinstance(r.g, str) else None: r.quantile for r in found.itertuples()} == {
        (g if isinstance(g, str) else None): pytest.approx(q, rel=1e-12) for g, q in expected.items()}


@pytest.mark.parametrize("text, expected", [
    ("1/5/2026 3:15 PM", "2026-01-05 15:15:00"), ("01/05/26", "2026-01-05 00:00:00"), ("1/5/69", "1969-01-05 00:00:00"),
    ("Jan 5 2026", "2026-01-05 00:00:00"), ("jan 5, 2026", "2026-01-05 00:00:00"), ("JAN 5, 2026", "2026-01-05 00:00:00"),
    ("2026.01.05", "2026-01-05 00:00:00"), ("5 January 2026 10:00", "2026-01-05 10:00:00"),
    ("Jan 5, 2026 10:00", "2026-01-05 10:00:00"), ("05-Jan-26", "2026-01-05 00:00:00"), ("Mon, 05 Jan 2026", "2026-01-05 00:00:00"),
    ("2026/01/05T10:00:00", "2026-01-05 10:00:00"), ("1/5/2026 10:00:00.250", "2026-01-05 10:00:00.250000"),
    ("12/31/2025 12:05 am", "2025-12-31 00:05:00"), ("12/31/2025 12:05 pm", "2025-12-31 12:05:00"), ("2026-01-05T10:00:00Z", "2026-01-05 10:00:00"),
    ("2026-01-05 10:00:00+02:00", "2026-01-05 08:00:00"), ("20260105", "2026-01-05 00:00:00"), ("Sept 9, 2025", "2025-09-09 00:00:00"),
    ("Jan 2026", "2026-01-01 00:00:00"), ("May 5th, 2026", "2026-05-05 00:00:00"), ("Jan-05-2026", "2026-01-05 00:00:00"),
    ("Mon Jan 5 10:00:00 2026", "2026-01-05 10:00:00"), ("2026-01-05 10:00 UTC", "2026-01-05 10:00:00"), ("2nd March 2026", "2026-03-02 00:00:00"),
    ("1/5/2026 10:00 +0200", "2026-01-05 08:00:00"), ("2026-01-05T10:00:00.5+02:00", "2026-01-05 08:00:00.500000"), ("\u0001|||", None), ("1/5-2026", None),
    ("10:00", None), ("13/45/2026", None), ("Janx 5 2026", None), ("1/5/2026 13:00 PM", None), ("", None), ("5", None), ("2026", None)])
def test_date_layouts(spark, text, expected):
    found = spark.createDataFrame([(text,)], "t string").select(to_ts(F.col("t"))).first()[0]
    assert (str(found) if found else None) == expected


def test_elected_readings(spark):
    columns = {
        "eu": ["13/01/2026", "05/01/2026", "x", None], "us": ["01/13/2026", "05/01/2026", "1/2/2026", ""], "dots": ["5.1.2026 10:00", "31.1.2026 11:00", None, None],
        "unclear": ["1/2/2026", "3/4/2026", None, None], "iso": ["2026-01-05", "2026-12-31", None, "?"], "clocks": ["2026-01-05T10:00:00Z", "2026-01-05", None, None],
        "both": ["13/01/2026", "14/01/2026", "1/15/2026", "2/1/2026"], "short": ["13/01/26", "1/2/26", None, None], "none": ["x", "", None, None]}
    df = spark.createDataFrame(list(zip(range(4), *columns.values())), ", ".join(["i int", *(f"{c} string" for c in columns)]))
    found = elect_dates(df, list(columns))
    assert found == {
        "eu": DateReading("d/M/yyyy", True, True), "us": DateReading("M/d/yyyy", False, True), "dots": DateReading("d.M.yyyy", True, False),
        "unclear": DateReading("M/d/yyyy", False, True), "iso": DateReading("yyyy-M-d", False, True), "clocks": DateReading("yyyy-M-d", False, False),
        "both": DateReading("d/M/yyyy", True, True), "short": DateReading("d/M/yy", True, False), "none": DateReading(None, False, False)}
    read = lambda c: results(df, to_ts(F.col(c), reading=found[c]).cast("string"))
    assert read("eu") == ["2026-01-13 00:00:00", "2026-01-05 00:00:00", None, None]
    assert read("us") == ["2026-01-13 00:00:00", "2026-05-01 00:00:00", "2026-01-02 00:00:00", None]
    assert read("dots") == ["2026-01-05 10:00:00", "2026-01-31 11:00:00", None, None]
    assert read("clocks") == ["2026-01-05 10:00:00", "2026-01-05 00:00:00", None, None]
    assert read("both") == ["2026-01-13 00:00:00", "2026-01-14 00:00:00", None, "2026-01-02 00:00:00"]
    assert read("short") == ["2026-01-13 00:00:00", "2026-02-01 00:00:00", None, None]
    assert elect_dates(df.select(F.lit(1).alias("n")), ["n"]) == {}


def test_a_reader_holds_its_pattern_once(spark):
    plan = column(spark, ["1/5/2026"]).select(to_ts(F.col("x")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_laying_dates_out_raises_no_errors_within_rows(spark):
    laid_out, facts = layout_facts(column(spark, ["2026-01-05", "", "x", "2026-01-05 ", "2026-1-5\n", None]), ["x"])
    read = column(spark, ["x"]).select(to_ts(F.col("x"), reading="MMM yyyy"))
    assert not any(re.search(r"try_cast\([^()]* as int\)", df._jdf.queryExecution().optimizedPlan().toString()) for df in (laid_out, read))
    counts = laid_out.agg(*[a.alias(f"{n}/{f}") for (n, f), a in facts.items()]).first().asDict()
    assert counts["x/yyyy-M-d/n"] == 2 and counts["x/all/plain"] == 3


def test_order_keys_keep_the_order_and_tell_values_apart(spark):
    rng = random.Random(4)
    near = [math.nextafter(2.0 ** e, to) for e in range(-1073, 1023, 7) for to in (0, math.inf)]
    values = sorted({0.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, *near, *(2.0 ** e for e in range(-1074, 1024)),
                     *(rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(3000)), *(rng.random() for _ in range(3000))})
    values = sorted({*values, *(-v for v in values)})
    keys = results(column(spark, values, "double"), order_key(F.col("x")))
    assert all(a < b for a, b in zip(keys, keys[1:]))
    assert results(column(spark, [0.0, -0.0], "double"), order_key(F.col("x"))) == [0, 0]


@pytest.mark.parametrize("values", [[-1e300, -5.0, 5e-324, 0.0, 1e300], [math.inf, 1.0, 2.0], [-math.inf, 1.0, 1.0], [7.25] * 9, [1.0, 1.0 + 2 ** -52]])
@pytest.mark.parametrize("p", [0.0, 0.5, 0.75, 1.0])
def test_quantile_of_wide_values(spark, values, p):
    found = quantiles(spark, pd.DataFrame({"v": values}), p, [])["quantile"][0]
    expected = pd.Series(values).quantile(p)
    assert found == expected or math.isnan(expected)  # pandas multiplies infinite steps by 0
