"""Chart-data queries (V1-V11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubjay.functions.exprs import round_half_away
from scrubjay.operators import charts as C
from scrubjay.suite import sqlgen as G
from scrubjay.plans.table import RID, Table
from scrubjay.suite.base import fixture, loaded, query, table
from scrubjay.suite.q_steps import EV_COLS

EV = ("ev_dirty",)
OH = ("ord_holes",)
LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]


@query("chart_histogram", G.histogram("ord_holes", "price", "least(50, greatest(10, n // 20))"), OH)
def chart_histogram(spark, sf):
    return C.chart_histogram(fixture(spark, sf, "ord_holes"), "price")


@query("chart_bar_count",
       "SELECT p_brand AS category, CAST(count(*) AS DOUBLE) AS value FROM part WHERE p_brand IS NOT NULL "
       "GROUP BY 1 ORDER BY value DESC, category LIMIT 15")
def chart_bar_count(spark, sf):
    return C.bar_counts(loaded(spark, sf, "part"), "p_brand")


@query("chart_bar_mean",
       "SELECT event_type AS category, round(avg(value), 4) AS value FROM events WHERE event_type IS NOT NULL "
       "GROUP BY 1 HAVING avg(value) IS NOT NULL ORDER BY avg(value) DESC, category LIMIT 15")
def chart_bar_mean(spark, sf):
    df = C.bar_mean(loaded(spark, sf, "events"), "event_type", "value")
    return df.select("category", round_half_away(F.col("value"), 4).alias("value"))


@query("chart_scatter_fit",
       "SELECT count(*) AS n, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept, "
       "round(corr(x, y), 3) AS r, min(x) AS x_min, max(x) AS x_max FROM "
       "(SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)")
def chart_scatter_fit(spark, sf):
    df = C.scatter_fit(loaded(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return df.select("n", round_half_away(F.col("slope"), 4).alias("slope"),
                     round_half_away(F.col("intercept"), 4).alias("intercept"), "r", "x_min", "x_max")


_BOX_STATS = ("count(price) AS n, min(price) AS mn, max(price) AS mx, quantile_cont(price, 0.25) AS q1, "
              "quantile_cont(price, 0.5) AS med, quantile_cont(price, 0.75) AS q3")
_BOX_OUT = ("n, round(mn, 4) AS min, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, "
            "round(mx, 4) AS max, round((SELECT min(price) FROM ord_holes o WHERE {g} price >= f.lo AND price <= f.hi), 4) "
            "AS whisk_lo, round((SELECT max(price) FROM ord_holes o WHERE {g} price >= f.lo AND price <= f.hi), 4) AS whisk_hi, "
            "(SELECT count(*) FROM ord_holes o WHERE {g} (price < f.lo OR price > f.hi)) AS n_fliers")


@query("chart_box",
       f"WITH q AS (SELECT {_BOX_STATS} FROM ord_holes), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, "
       f"q3 + 1.5 * (q3 - q1) AS hi FROM q) SELECT CAST(NULL AS VARCHAR) AS grp, CAST(NULL AS VARCHAR) AS label, "
       + _BOX_OUT.format(g="") + " FROM f", OH)
def chart_box(spark, sf):
    return C.box(fixture(spark, sf, "ord_holes"), "price")


@query("chart_box_group",
       "WITH g AS (SELECT DISTINCT priority AS k FROM ord_holes WHERE priority IS NOT NULL ORDER BY k LIMIT 10), "
       f"q AS (SELECT g.k, {_BOX_STATS} FROM g JOIN ord_holes o ON o.priority = g.k GROUP BY g.k), "
       "f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) "
       "SELECT k AS grp, substr(k, 1, 15) AS label, " + _BOX_OUT.format(g="o.priority = f.k AND") + " FROM f", OH)
def chart_box_group(spark, sf):
    return C.box(fixture(spark, sf, "ord_holes"), "price", "priority")


@query("chart_line",
       "SELECT rid, odate AS x, price AS y, row_number() OVER (ORDER BY odate NULLS LAST, rid) - 1 AS pos FROM ord_holes", OH)
def chart_line(spark, sf):
    return C.line(fixture(spark, sf, "ord_holes"), "price", "odate").withColumnRenamed("_rid", "rid")


@query("chart_line_rows",
       "SELECT rid, CAST(row_number() OVER (ORDER BY rid) - 1 AS VARCHAR) AS x, price AS y, "
       "row_number() OVER (ORDER BY rid) - 1 AS pos FROM ord_holes", OH)
def chart_line_rows(spark, sf):
    return C.line(fixture(spark, sf, "ord_holes"), "price").withColumnRenamed("_rid", "rid")


@query("chart_corr", G.union([
    f"SELECT '{a}' AS col_x, '{b}' AS col_y, round(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END, 4) "
    f"AS r FROM lineitem" for a in LI_NUM for b in LI_NUM]))
def chart_corr(spark, sf):
    return C.corr_matrix(loaded(spark, sf, "lineitem"))


@query("chart_pie_count",
       "WITH t AS (SELECT event_type AS category, CAST(count(*) AS DOUBLE) AS value FROM events WHERE event_type IS NOT NULL "
       "GROUP BY 1 ORDER BY value DESC, category LIMIT 8) "
       "SELECT category, value, round(value / sum(value) OVER () * 100, 1) AS share_pct FROM t")
def chart_pie_count(spark, sf):
    return C.pie_counts(loaded(spark, sf, "events"), "event_type")


@query("chart_pie_sum",
       "WITH s AS (SELECT event_type AS category, coalesce(sum(value), 0.0) AS value FROM events WHERE event_type IS NOT NULL "
       "GROUP BY 1 ORDER BY value DESC, category LIMIT 8), t AS (SELECT * FROM s WHERE value > 0) "
       "SELECT category, round(value, 4) AS value, round(value / sum(value) OVER () * 100, 1) AS share_pct FROM t")
def chart_pie_sum(spark, sf):
    df = C.pie_sum(loaded(spark, sf, "events"), "event_type", "value")
    return df.select("category", round_half_away(F.col("value"), 4).alias("value"), "share_pct")


_EV_NUM = {"user_id", "value", "value_sparse"}


@query("chart_slots", G.union([
    f"SELECT '{c}' AS column, {str(c in _EV_NUM).lower()} AS is_num, "
    f"(NOT {str(c in _EV_NUM).lower()} OR count(DISTINCT {c}) <= 20) AS is_cat FROM ev_dirty" for c in EV_COLS]),
    ("ev_dirty",))
def chart_slots(spark, sf):
    return C.chart_slots(fixture(spark, sf, "ev_dirty"))


_SLOTS = ("('histogram', 'x', 'num', true), ('bar', 'x', 'cat', true), ('bar', 'y', 'num', false), ('scatter', 'x', 'num', true), "
          "('scatter', 'y', 'num', true), ('box', 'x', 'cat', false), ('box', 'y', 'num', true), ('line', 'x', 'any', false), "
          "('line', 'y', 'num', true), ('pie', 'x', 'cat', true), ('pie', 'y', 'num', false)")


@query("chart_options",
       f"WITH s(chart, slot, kind, required) AS (VALUES {_SLOTS}), c AS (" + G.union([
           f"SELECT '{c}' AS column, {str(c in _EV_NUM).lower()} AS is_num, "
           f"(NOT {str(c in _EV_NUM).lower()} OR count(DISTINCT {c}) <= 20) AS is_cat FROM ev_dirty" for c in EV_COLS]) + ") "
       "SELECT chart, slot, required, column FROM s JOIN c ON kind = 'any' OR (kind = 'num' AND is_num) OR (kind = 'cat' AND is_cat)",
       ("ev_dirty",))
def chart_options(spark, sf):
    return C.chart_options(fixture(spark, sf, "ev_dirty"))


@query("chart_auto",
       "SELECT 'histogram' AS chart, column, CAST(bin AS VARCHAR) AS label, CAST(count AS DOUBLE) AS value FROM ("
       + G.histogram("ord_holes", "price", "least(50, greatest(10, n // 20))") + ") "
       "UNION ALL SELECT 'bar', 'priority', priority, CAST(count(*) AS DOUBLE) FROM ord_holes WHERE priority IS NOT NULL GROUP BY 3 "
       "UNION ALL SELECT 'bar', 'status', status, CAST(count(*) AS DOUBLE) FROM ord_holes WHERE status IS NOT NULL GROUP BY 3",
       OH)
def chart_auto(spark, sf):
    return C.auto_charts(fixture(spark, sf, "ord_holes"))


_NUMS = ["user_id", "value", "value_sparse"]


@query("chart_auto_dirty",
       " UNION ALL ".join(
           "SELECT 'histogram' AS chart, column, CAST(bin AS VARCHAR) AS label, CAST(count AS DOUBLE) AS value FROM ("
           + G.histogram("ev_dirty", c, "least(50, greatest(10, n // 20))") + ")" for c in _NUMS)
       + " UNION ALL SELECT * FROM (SELECT 'bar', 'type_case', type_case, CAST(count(*) AS DOUBLE) AS n FROM ev_dirty "
       "WHERE type_case IS NOT NULL GROUP BY type_case ORDER BY n DESC, type_case LIMIT 15)"
       + "".join(f" UNION ALL SELECT 'heatmap', '{a}', '{b}', round(corr({a}, {b}), 4) FROM ev_dirty" for a in _NUMS for b in _NUMS), EV)
def chart_auto_dirty(spark, sf):
    """Three numeric columns: three histograms and the correlation matrix; a text column of many values has no bars."""
    return C.auto_charts(fixture(spark, sf, "ev_dirty"))


@query("chart_scatter_points",
       "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem "
       "WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def chart_scatter_points(spark, sf):
    return C.scatter_points(loaded(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select("x", "y")


@query("chart_scatter_thin",
       "SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity AS x, l_extendedprice AS y FROM lineitem "
       "WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL "
       "ORDER BY substr(md5(CAST(l_orderkey * 8 + l_linenumber AS VARCHAR)), 1, 15), id LIMIT 2000")
def chart_scatter_thin(spark, sf):
    """2,000 of all line items, chosen by the hash of their row id (order and line number)."""
    t = Table(table(spark, sf, "lineitem").withColumn(RID, F.col("l_orderkey") * 8 + F.col("l_linenumber")))
    return C.scatter_thin(t, "l_quantity", "l_extendedprice", 2000).withColumnRenamed(RID, "id")


def _thin_sql(rows: str, buckets: int) -> str:
    """First, last, lowest and highest point of each bucket of ``rows`` (rid, a, x, y)."""
    first = "row_number() OVER (PARTITION BY bucket ORDER BY {} rid {}) = 1"
    return (f"WITH p AS ({rows}), e AS (SELECT min(a) AS lo, (max(a) - min(a)) // {buckets} + 1 AS width FROM p), "
            "b AS (SELECT p.*, (a - lo) // width AS bucket FROM p, e) SELECT rid, x, y, bucket FROM b QUALIFY "
            + " OR ".join([first.format("a,", ""), first.format("a DESC,", "DESC"), first.format("y,", ""), first.format("y DESC,", "")]))


@query("chart_line_thin", _thin_sql("SELECT rid, epoch_us(odate) * 1000 AS a, odate AS x, price AS y FROM ord_holes "
                                    "WHERE odate IS NOT NULL AND price IS NOT NULL", 100), OH)
def chart_line_thin(spark, sf):
    return C.line_thin(fixture(spark, sf, "ord_holes"), "price", "odate", 100).withColumnRenamed("_rid", "rid")


@query("chart_line_thin_rows", _thin_sql("SELECT rid, rid AS a, CAST(rid AS VARCHAR) AS x, value AS y FROM ev_dirty WHERE value IS NOT NULL", 250), EV)
def chart_line_thin_rows(spark, sf):
    return C.line_thin(fixture(spark, sf, "ev_dirty"), "value", None, 250).withColumnRenamed("_rid", "rid")
