"""Small-frame differential tests of the expression helpers against pandas /
numpy / the Python standard library expressions of the documented semantics."""

import datetime as dt
import difflib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubjay.functions.dates import DATE_CLASSES, PARSE_FORMATS, class_counts, date_class, parse_text, strftime_to_java, try_parse
from scrubjay.functions.exprs import is_title, pround, strip, title, to_num, to_str
from scrubjay.functions.moments import correlations, moments, skew_from
from scrubjay.functions.quantiles import exact_quantiles
from scrubjay.operators.quality import difflib_ratio


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {typ}")


NUM_TEXT = [" 12 ", "1,000", "1e3", "inf", "True", "0x1A", "12d", "3f", "-5", "+5", "nan", ""]


def test_to_num_matches_pandas(spark):
    got = [r[0] for r in one_col(spark, NUM_TEXT).select(to_num(F.col("c"), T.StringType())).collect()]
    want = pd.to_numeric(pd.Series(NUM_TEXT, dtype=object), errors="coerce").tolist()
    for g, w in zip(got, want):
        assert (g is None and (w is None or math.isnan(w))) or g == w


DATE_TEXT = ["2024-01-05", "05/01/2024", "13/02/2024", "13-02-2024", "March 5, 2024", "20240105",
             "2024-1-5", "junk", None]
DATE_WANT = [dt.datetime(2024, 1, 5), dt.datetime(2024, 5, 1), dt.datetime(2024, 2, 13),
             dt.datetime(2024, 2, 13), dt.datetime(2024, 3, 5), dt.datetime(2024, 1, 5),
             dt.datetime(2024, 1, 5), None, None]


def test_date_parsing_month_first(spark):
    got = [r[0] for r in one_col(spark, DATE_TEXT).select(parse_text(F.col("c"))).collect()]
    assert got == DATE_WANT


def test_strftime_translation():
    assert strftime_to_java("%Y-%m-%d") == "yyyy-MM-dd"
    assert strftime_to_java("%B %d, %Y") == "MMMM dd, yyyy"
    assert strftime_to_java("%d/%m/%Y at %H") == "dd/MM/yyyy 'at' HH"


def test_title_and_istitle(spark):
    vals = ["o'neil-smith 3rd new YORK", "Hello World", "hello World", "HELLO", "Abc1Def", "x", "3rd"]
    rows = one_col(spark, vals).select(title(F.col("c")), is_title(F.col("c"))).collect()
    for v, r in zip(vals, rows):
        assert r[0] == v.title()
        assert r[1] == v.istitle()


def test_unicode_strip(spark):
    vals = [" x\t", "  x  ", "x", "　 y \n"]
    got = [r[0] for r in one_col(spark, vals).select(strip(F.col("c"))).collect()]
    assert got == [v.strip() for v in vals]


def test_to_str_doubles(spark):
    vals = [10000000.0, 6.55, 1.0, -2.5, 12345678.9, None]
    got = [r[0] for r in one_col(spark, vals, "double").select(to_str(F.col("c"), T.DoubleType())).collect()]
    assert got == [None if v is None else str(v) for v in vals]


def test_skew_corrected(spark):
    df = one_col(spark, [1.0, 2.0, 3.0, 10.0], "double")
    m = moments(df, {"c": F.col("c")})["c"]
    assert skew_from(m) == 1.76  # pandas Series.skew, not the population 1.02
    const = moments(one_col(spark, [0.1] * 5, "double"), {"c": F.col("c")})["c"]
    assert skew_from(const) == 0.0


def test_correlations_pairwise_and_constant(spark):
    rnd = random.Random(7)
    rows = [(rnd.random(), None if i % 5 == 0 else rnd.random(), 3.0) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, k double")
    rs = correlations(df, {c: F.col(c) for c in ("a", "b", "k")})
    pdf = pd.DataFrame(rows, columns=["a", "b", "k"])
    assert rs[("a", "b")] == pytest.approx(pdf["a"].corr(pdf["b"]), abs=1e-12)
    assert rs[("a", "a")] == pytest.approx(1.0)
    assert rs[("a", "k")] is None


@pytest.mark.parametrize("dist", ["uniform", "skewed", "ties", "tiny"])
def test_exact_quantiles_match_numpy(spark, dist, monkeypatch):
    import scrubjay.functions.quantiles as q
    monkeypatch.setattr(q, "FINAL_ROWS", 16)  # force several refinement passes
    rnd = np.random.default_rng(3)
    x = {"uniform": rnd.uniform(-5, 5, 5000), "skewed": rnd.lognormal(0, 2, 5000),
         "ties": rnd.integers(0, 4, 5000).astype(float), "tiny": np.array([2.0, 1.0])}[dist]
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(7)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, [("v", F.col("v"), None)], probs)["v"]
    want = np.quantile(x, probs)
    assert got == pytest.approx(list(want), rel=1e-12, abs=1e-12)


def test_exact_quantiles_conditions_and_infinities(spark):
    vals = [(float("-inf"), "a"), (1.0, "a"), (2.0, "a"), (float("inf"), "a"), (5.0, "b"), (None, "b")]
    df = spark.createDataFrame(vals, "v double, g string")
    out = exact_quantiles(df, [("a", F.col("v"), F.col("g") == "a"), ("b", F.col("v"), F.col("g") == "b")], [0.5])
    assert out["a"] == [1.5]
    assert out["b"] == [5.0]


def test_difflib_ratio_udf(spark):
    pairs = [("click", "clic"), ("view", "vie"), ("purchase", "purchas"), ("abc", "xyz")]
    df = spark.createDataFrame(pairs, "m string, v string")
    got = [r[0] for r in df.select(difflib_ratio("m", "v")).collect()]
    want = [difflib.SequenceMatcher(None, m, v).ratio() for m, v in pairs]
    assert got == pytest.approx(want)


def test_pround_half_away():
    assert pround(2.5, 0) == 3.0 and pround(-2.5, 0) == -3.0 and pround(1.23456, 4) == 1.2346
    assert pround(None, 2) is None


def test_exact_quantiles_sort_fallback(spark, monkeypatch):
    """Values spread over many binary orders of magnitude converge slowly under
    equal-width bins; the distributed sort fallback must give the same answer."""
    import scrubjay.functions.quantiles as q
    monkeypatch.setattr(q, "FINAL_ROWS", 8)
    monkeypatch.setattr(q, "MAX_PASSES", 1)
    x = [2.0 ** -k for k in range(0, 600, 3)] + [1e300, -1e-300]
    df = spark.createDataFrame([(v,) for v in x], "v double").repartition(5)
    probs = [0.1, 0.5, 0.9]
    got = exact_quantiles(df, [("v", F.col("v"), None)], probs)["v"]
    assert got == pytest.approx(list(np.quantile(np.array(x), probs)), rel=1e-12)


def test_distinct_counts_one_pass_matches_count_distinct(spark):
    import datetime as _dt
    from scrubjay.operators.profile import distinct_counts
    rows = [(1, 0.0, "a", True, _dt.datetime(2024, 1, 1), _dt.date(2024, 1, 1)),
            (1, -0.0, "a", False, _dt.datetime(2024, 1, 1, 0, 0, 1), _dt.date(2024, 1, 2)),
            (2, float("nan"), "b", None, None, None),
            (None, float("nan"), None, True, _dt.datetime(2024, 1, 1), _dt.date(2024, 1, 1)),
            (3, 1.5, "1", False, None, None)]
    df = spark.createDataFrame(rows, "i long, d double, s string, b boolean, t timestamp_ntz, dt date") \
        .withColumn("lt", F.col("t").cast("timestamp")).withColumn("arr", F.array("i", "i"))
    cols = df.columns
    got = distinct_counts(df, cols)
    want = df.agg(*[F.countDistinct(c).alias(c) for c in cols]).first().asDict()
    assert got == want


SHAPED_TEXT = [f"{a}{s}{b}{s}{y}" for s in "-/" for a in ("1", "02", "12", "13", "30", "31", "00", "32") for b in ("2", "05", "12", "13", "29", "31") for y in ("2023", "2024", "0000", "24")]
SHAPED_TEXT += [f"{y}{s}{m}{s}{d}{t}" for s in ("-", "") for y in ("2023", "2024", "0000") for m in ("1", "02", "13") for d in ("9", "29", "30", "32")
              for t in ("", " 1:2:3", " 23:59:59", "T23:59:59", "T24:00:00", "\n", " ")]
SHAPED_TEXT += [f"{m} {d}, {y}" for m in ("May", "may", "MAY", "Jan", "January", "Sept", "Sep", "September", "febr", "Feb", "Foo", "Februaryy")
              for d in ("1", "05", "29", "30", "31", "32") for y in ("2023", "2024", "0000", "202")]
SHAPED_TEXT += ["", " ", "2024", "x" * 50, "2024-01-05 and more words", "20240105x", "1-2-3", None, "12/13/2024/2", "１２/11/2024"]


def test_one_parse_by_shape_is_all_formats_in_turn(spark):
    df = one_col(spark, SHAPED_TEXT)
    tried = [try_parse(F.col("c"), java).cast("timestamp_ntz") for java, _ in PARSE_FORMATS]
    rows = df.select("c", parse_text(F.col("c")).cast("string").alias("one"), F.coalesce(*tried).cast("string").alias("all")).collect()
    assert [(r["c"], r["one"]) for r in rows] == [(r["c"], r["all"]) for r in rows]
    assert sum(r["one"] is not None for r in rows) > 150


def test_counts_of_classes_are_counts_of_formats(spark):
    df = one_col(spark, SHAPED_TEXT)
    want = list(df.agg(*[F.count(try_parse(F.col("c"), java)).alias(f"f{i}") for i, (java, _) in enumerate(PARSE_FORMATS)]).first())
    classes = {r[0]: r[1] for r in df.groupBy(date_class(F.col("c"))).count().collect() if r[0] is not None}
    assert set(classes) <= set(DATE_CLASSES)
    assert class_counts(classes) == want and min(want) > 0


def test_distinct_long_texts_by_digest(spark):
    from scrubjay.operators.profile import distinct_counts
    long = "y" * 31
    vals = [long, long + "a", long + "b", long + "a", "", None, "é" * 16, "é" * 15 + "e", long[:-1], "z" * 5000, "z" * 5000]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(vals)], "c string, k int")
    assert distinct_counts(df, ["c", "k"]) == {"c": len(set(vals) - {None}), "k": 3}
