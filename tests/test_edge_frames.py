"""Edge frames through profile, findings and charts: nothing may raise, and
the documented degenerate answers come out."""

import pytest

from scrubjay.operators import charts as C
from scrubjay.operators import profile as P
from scrubjay.operators import quality as Q
from scrubjay.operators.steps import apply_step
from scrubjay.plans.table import Table
from scrubjay.sources.files import normalise_nulls

SCHEMA = "id long, k double, nul double, b boolean, s string, x double"


def table(spark, rows):
    df = normalise_nulls(spark.createDataFrame(rows, SCHEMA))
    return Table.from_df(df, rid="id")


def edge_rows():
    return [(i, 3.0, None, i % 2 == 0, None if i == 1 else "v", float("nan") if i == 2 else float(i))
            for i in range(6)]


@pytest.mark.parametrize("rows", [[], [(0, 1.0, None, True, "a", 2.0)], edge_rows()], ids=["empty", "one", "edge"])
def test_no_operator_raises(spark, rows):
    t = table(spark, rows)
    P.column_profile(t).collect()
    P.top_values(t).collect()
    P.dataset_summary(t).collect()
    for c in ("k", "nul", "x"):
        P.histogram(t, c).collect()
        P.box_summary(t, c)[0].collect()
    Q.findings(t).collect()
    C.corr_matrix(t).collect()
    C.box(t, "x", "s").collect()
    C.pie_sum(t, "s", "x").collect()
    C.chart_slots(t).collect()
    C.auto_charts(t).collect()
    for m in ("mean", "median", "mode", "ffill", "bfill", "zero"):
        apply_step(t, "fill_missing", None, {"method": m}).df.collect()
    apply_step(t, "handle_outliers", "x", {"method": "cap"}).df.collect()


def test_degenerate_answers(spark):
    t = table(spark, edge_rows())
    h = P.histogram(t, "k").collect()  # constant column: one bin spanning +-0.5
    assert [(r["bin_lo"], r["bin_hi"], r["count"]) for r in h] == [(2.5, 3.5, 6)]
    assert P.histogram(t, "nul").count() == 0  # all null: nothing to draw
    r = {(x["col_x"], x["col_y"]): x["r"] for x in C.corr_matrix(t).collect()}
    assert r[("k", "x")] is None  # constant column: no correlation
    prof = {x["column"]: x for x in P.column_profile(t).collect()}
    assert prof["x"]["null_count"] == 1  # NaN normalised to null
    assert prof["nul"]["mean"] is None and prof["nul"]["null_pct"] == 100.0
    miss = {x["column"]: x["method"] for x in Q.missing(t).collect()}
    assert miss["nul"] == "zero" and miss["s"] == "mode"
    slots = {x["column"]: (x["is_num"], x["is_cat"]) for x in C.chart_slots(t).collect()}
    assert slots["b"] == (False, True) and slots["k"] == (True, True)


def test_panel_of_awkward_columns(spark):
    schema = "x double, n int, s string, e double, b boolean, rid long"
    rows = [(1.0, 5, "a", None, True, 1), (2.0, 5, "a", None, None, 2), (None, 5, None, None, False, 3), (9.0, 5, "b", None, True, 4)]
    for approx in (False, True):
        got = {r["column"]: r for r in P.column_panel(Table.from_df(spark.createDataFrame(rows, schema), rid="rid"), approx_distinct=approx).collect()}
        assert [(b["bin"], b["count"]) for b in got["x"]["bins"]] == [(0, 2), (1, 0), (2, 1)] and got["x"]["top"] is None
        assert [tuple(b) for b in got["n"]["bins"]] == [(0, 4.5, 5.5, 4)]
        assert [(v["value"], v["count"]) for v in got["s"]["top"]] == [("a", 2), ("b", 1)] and got["s"]["bins"] is None
        assert got["e"]["bins"] is None and got["e"]["null_count"] == 4 and [v["value"] for v in got["b"]["top"]] == ["true", "false"]
    empty = P.column_panel(Table.from_df(spark.createDataFrame([], schema), rid="rid")).collect()
    assert [(r["column"], r["null_pct"], r["bins"], r["top"]) for r in empty if r["column"] in "xs"] == [("x", 0.0, None, None), ("s", 0.0, None, [])]
