"""Queries for projections, filters, fills, casts, dates, outliers, text steps,
ordered steps (sort, ffill/bfill, dedup) and cell patches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from scrubjay.operators.patches import apply_patches, drop_rows
from scrubjay.operators.quality import typo_candidates
from scrubjay.operators.steps import apply_step
from scrubjay.plans.recipe import Recipe, Step, diff_cells
from scrubjay.functions.exprs import round_half_away
from scrubjay.plans.table import RID
from scrubjay.sources.pages import fence_index, slice_rows
from scrubjay.suite import sqlfrag as S
from scrubjay.suite.base import fixture, fixture_df, out, query

EV = ("ev_dirty",)
OH = ("ord_holes",)
EV_COLS = ["ts", "user_id", "value", "value_sparse", "num_text", "type_case", "type_pad",
           "type_typo", "event_type", "date_text"]


def _step(spark, sf, fx, typ, column=None, params=None):
    return apply_step(fixture(spark, sf, fx), typ, column, params or {})


def _r4(df, *names):
    return df.select(*[round_half_away(F.col(c), 4).alias(c) if c in names else F.col("`" + c + "`") for c in df.columns])


# -- projections ----------------------------------------------------------------------------------
@query("proj_drop", "SELECT * EXCLUDE (date_text) FROM ev_dirty", EV)
def proj_drop(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "drop_column", "date_text"))


@query("proj_rename", "SELECT * RENAME (event_type AS kind) FROM ev_dirty", EV)
def proj_rename(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "rename_column", "event_type", {"new_name": "kind"}))


@query("proj_header_row",
       "SELECT rid, CAST(c0 AS BIGINT) AS id, c1 AS kind, CAST(c2 AS DOUBLE) AS amount FROM raw_header WHERE rid <> 0",
       ("raw_header",))
def proj_header_row(spark, sf):
    return out(_step(spark, sf, "raw_header", "set_header_row", None, {"row": 0}))


@query("proj_header_dups", "SELECT rid, CAST(c0 AS BIGINT) AS a, c1 AS a_1, CAST(c2 AS BIGINT) AS a_2 FROM raw_dups WHERE rid <> 0", ("raw_dups",))
def proj_header_dups(spark, sf):
    return out(_step(spark, sf, "raw_dups", "set_header_row", None, {"row": 0}))


# -- filters ------------------------------------------------------------------------------------------
def _filter(spark, sf, column, cond, value=None, show="event_type"):
    t = _step(spark, sf, "ev_dirty", "filter_rows", column, {"condition": cond, "value": value})
    return out(t, *dict.fromkeys([column, show]))


@query("filter_not_null", "SELECT rid, event_type FROM ev_dirty WHERE event_type IS NOT NULL", EV)
def filter_not_null(spark, sf):
    return _filter(spark, sf, "event_type", "not_null")


@query("filter_equals", "SELECT rid, event_type FROM ev_dirty WHERE event_type = 'view'", EV)
def filter_equals(spark, sf):
    return _filter(spark, sf, "event_type", "equals", "view")


@query("filter_not_equals", "SELECT rid, event_type FROM ev_dirty WHERE event_type IS DISTINCT FROM 'view'", EV)
def filter_not_equals(spark, sf):
    return _filter(spark, sf, "event_type", "not_equals", "view")


@query("filter_contains",
       "SELECT rid, type_case, event_type FROM ev_dirty WHERE regexp_matches(type_case, '(?i)cl|ER')", EV)
def filter_contains(spark, sf):
    return _filter(spark, sf, "type_case", "contains", "cl|ER")


@query("filter_gt", f"SELECT rid, num_text, event_type FROM ev_dirty WHERE {S.num('num_text')} > 50", EV)
def filter_gt(spark, sf):
    return _filter(spark, sf, "num_text", "greater_than", "50")


@query("filter_lt", "SELECT rid, value, event_type FROM ev_dirty WHERE value < 10", EV)
def filter_lt(spark, sf):
    return _filter(spark, sf, "value", "less_than", "10")


@query("filter_drop_missing", "SELECT rid, value FROM ev_dirty WHERE value IS NOT NULL", EV)
def filter_drop_missing(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "drop_missing_rows", "value"), "value")


@query("filter_drop_missing_any",
       "SELECT rid, event_type FROM ev_dirty WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in EV_COLS), EV)
def filter_drop_missing_any(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "drop_missing_rows"), "event_type")


@query("filter_drop_rows",
       "SELECT rid, event_type FROM ev_dirty WHERE rid NOT IN (SELECT rid FROM cell_patches)",
       ("ev_dirty", "cell_patches"))
def filter_drop_rows(spark, sf):
    t = fixture(spark, sf, "ev_dirty")
    ids = fixture_df(spark, sf, "cell_patches").select(F.col("rid").alias(RID)).distinct()
    return out(drop_rows(t, ids), "event_type")


# -- fills --------------------------------------------------------------------------------------------------
@query("fill_mean", "SELECT rid, round(coalesce(price, (SELECT avg(price) FROM ord_holes)), 4) AS price FROM ord_holes", OH)
def fill_mean(spark, sf):
    t = _step(spark, sf, "ord_holes", "fill_missing", "price", {"method": "mean"})
    return _r4(out(t, "price"), "price")


@query("fill_median",
       "SELECT rid, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM ev_dirty)), 4) AS value FROM ev_dirty", EV)
def fill_median(spark, sf):
    return _r4(out(_step(spark, sf, "ev_dirty", "fill_missing", "value", {"method": "median"}), "value"), "value")


@query("fill_zero", "SELECT rid, coalesce(value, 0.0) AS value FROM ev_dirty", EV)
def fill_zero(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "fill_missing", "value", {"method": "zero"}), "value")


def _mode_sql(c):
    return f"(SELECT {c} FROM ev_dirty WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("fill_mode", f"SELECT rid, coalesce(event_type, {_mode_sql('event_type')}) AS event_type FROM ev_dirty", EV)
def fill_mode(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "fill_missing", "event_type", {"method": "mode"}), "event_type")


_FILLED = {"value", "value_sparse", "type_case", "event_type"}


@query("fill_all_columns",
       "SELECT rid, " + ", ".join(f"coalesce({c}, {_mode_sql(c)}) AS {c}" if c in _FILLED else c for c in EV_COLS)
       + " FROM ev_dirty", EV)
def fill_all_columns(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "fill_missing", None, {"method": "mode"}))


@query("fill_empty", "SELECT rid, coalesce(type_case, '') AS type_case FROM ev_dirty", EV)
def fill_empty(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "fill_missing", "type_case", {"method": "empty_string"}), "type_case")


@query("fill_custom", "SELECT rid, coalesce(value, -1.0) AS value FROM ev_dirty", EV)
def fill_custom(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "fill_missing", "value", {"method": "custom", "value": "-1"}), "value")


def _ties_sql(c):
    return f"coalesce({c}, (SELECT {c} FROM ev_ties WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}"


@query("fill_mode_ties", "SELECT rid, " + ", ".join(map(_ties_sql, ("num", "txt", "whole"))) + " FROM ev_ties", ("ev_ties",))
def fill_mode_ties(spark, sf):
    """Equally frequent values: the smallest in the column's own type, for all columns at once."""
    return out(_step(spark, sf, "ev_ties", "fill_missing", None, {"method": "mode"}))


# -- type conversion ---------------------------------------------------------------------------------
@query("cast_numeric", f"SELECT rid, {S.num('num_text')} AS num_text FROM ev_dirty", EV)
def cast_numeric(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "convert_type", "num_text", {"target": "numeric"}), "num_text")


@query("cast_datetime", f"SELECT rid, {S.ts('date_text')} AS date_text FROM ev_dirty", EV)
def cast_datetime(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "convert_type", "date_text", {"target": "datetime"}), "date_text")


@query("cast_string", "SELECT rid, CAST(value AS VARCHAR) AS value FROM ev_dirty", EV)
def cast_string(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "convert_type", "value", {"target": "string"}), "value")


@query("cast_string_double", "SELECT rid, CAST(x AS VARCHAR) AS x FROM ev_doubles", ("ev_doubles",))
def cast_string_double(spark, sf):
    return out(_step(spark, sf, "ev_doubles", "convert_type", "x", {"target": "string"}), "x")


@query("filter_equals_double",
       "SELECT rid, x FROM ev_doubles WHERE CAST(x AS VARCHAR) IN ('0.0005', '1e+16', '-1e-06', '0.0', '0.000123')", ("ev_doubles",))
def filter_equals_double(spark, sf):
    t = fixture(spark, sf, "ev_doubles")
    parts = [out(apply_step(t, "filter_rows", "x", {"condition": "equals", "value": v}), "x")
             for v in ("0.0005", "1e+16", "-1e-06", "0.0", "0.000123")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("cast_string_ts",
       "SELECT rid, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') "
       "ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts FROM ev_dirty", EV)
def cast_string_ts(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "convert_type", "ts", {"target": "string"}), "ts")


# -- dates ----------------------------------------------------------------------------------------------------
ALL_PARTS = ["year", "quarter", "month", "month_name", "day", "weekday", "hour"]
_T = S.ts("date_text")


@query("date_split",
       f"SELECT rid, date_text, CAST(year({_T}) AS DOUBLE) AS date_text_year, CAST(quarter({_T}) AS DOUBLE) AS date_text_quarter, "
       f"CAST(month({_T}) AS DOUBLE) AS date_text_month, monthname({_T}) AS date_text_month_name, "
       f"CAST(day({_T}) AS DOUBLE) AS date_text_day, dayname({_T}) AS date_text_weekday, "
       f"CAST(hour({_T}) AS DOUBLE) AS date_text_hour FROM ev_dirty", EV)
def date_split(spark, sf):
    t = _step(spark, sf, "ev_dirty", "split_datetime", "date_text", {"components": ALL_PARTS})
    return out(t, "date_text", *[f"date_text_{p}" for p in ALL_PARTS])


@query("date_split_odate",
       "SELECT rid, odate, CAST(year(odate) AS DOUBLE) AS odate_year, CAST(month(odate) AS DOUBLE) AS odate_month FROM ord_holes", OH)
def date_split_odate(spark, sf):
    return out(_step(spark, sf, "ord_holes", "split_datetime", "odate"), "odate", "odate_year", "odate_month")


@query("date_std_iso", f"SELECT rid, strftime({_T}, '%Y-%m-%d') AS date_text FROM ev_dirty", EV)
def date_std_iso(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "standardize_date", "date_text", {"format": "%Y-%m-%d"}), "date_text")


@query("date_std_long", f"SELECT rid, strftime({_T}, '%B %d, %Y') AS date_text FROM ev_dirty", EV)
def date_std_long(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "standardize_date", "date_text", {"format": "%B %d, %Y"}), "date_text")


# -- outliers ----------------------------------------------------------------------------------------------------
_FENCES = ("WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ev_dirty), "
           "b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) ")


@query("outlier_cap",
       _FENCES + "SELECT rid, round(CASE WHEN value IS NULL THEN NULL ELSE least(greatest(value, lo), hi) END, 4) AS value "
                 "FROM ev_dirty, b", EV)
def outlier_cap(spark, sf):
    return _r4(out(_step(spark, sf, "ev_dirty", "handle_outliers", "value", {"method": "cap"}), "value"), "value")


@query("outlier_remove",
       _FENCES + "SELECT rid, value FROM ev_dirty, b WHERE (value >= lo AND value <= hi) OR value IS NULL", EV)
def outlier_remove(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "handle_outliers", "value", {"method": "remove"}), "value")


@query("outlier_nullify",
       _FENCES + "SELECT rid, CASE WHEN value < lo OR value > hi THEN NULL ELSE value END AS value FROM ev_dirty, b", EV)
def outlier_nullify(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "handle_outliers", "value", {"method": "nullify"}), "value")


@query("outlier_zscore",
       "WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM ev_dirty) "
       "SELECT rid, value FROM ev_dirty, s WHERE abs((value - m) / sd) <= 3", EV)
def outlier_zscore(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "handle_outliers", "value", {"method": "zscore"}), "value")


# -- text ------------------------------------------------------------------------------------------------------------
@query("case_lower", "SELECT rid, lower(type_case) AS type_case FROM ev_dirty", EV)
def case_lower(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "standardize_case", "type_case", {"case": "lower"}), "type_case")


@query("case_upper", "SELECT rid, upper(type_case) AS type_case FROM ev_dirty", EV)
def case_upper(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "standardize_case", "type_case", {"case": "upper"}), "type_case")


@query("case_title", f"SELECT rid, {S.title('type_case')} AS type_case FROM ev_dirty", EV)
def case_title(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "standardize_case", "type_case", {"case": "title"}), "type_case")


@query("case_title_uncased",
       "SELECT rid, CASE rid % 5 WHEN 0 THEN '中A 中A' WHEN 1 THEN 'Ssa Straße' WHEN 2 THEN 'O''Neil-Smith 3Rd' WHEN 3 THEN 'École Élan' "
       "ELSE concat(upper(substr(word, 1, 1)), substr(word, 2)) END AS word FROM ev_uncased", ("ev_uncased",))
def case_title_uncased(spark, sf):
    return out(_step(spark, sf, "ev_uncased", "standardize_case", "word", {"case": "title"}), "word")


@query("case_strip", f"SELECT rid, {S.strip('type_pad')} AS type_pad FROM ev_dirty", EV)
def case_strip(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "standardize_case", "type_pad", {"case": "strip"}), "type_pad")


@query("text_trim", f"SELECT rid, {S.strip('type_pad')} AS type_pad FROM ev_dirty", EV)
def text_trim(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "trim_whitespace", "type_pad"), "type_pad")


@query("text_fix_typos",
       "WITH m AS (SELECT DISTINCT substr(event_type, 1, length(event_type) - 1) AS bad, event_type AS good FROM events) "
       "SELECT rid, coalesce(m.good, type_typo) AS type_typo FROM ev_dirty LEFT JOIN m ON type_typo = m.bad", EV)
def text_fix_typos(spark, sf):
    t = fixture(spark, sf, "ev_dirty")
    # the mapping is frozen from the detector's output (<= 200 values by rule)
    found = typo_candidates(t, ["type_typo"]).select("value", "match").collect()
    mapping = {r["value"]: r["match"] for r in found}
    return out(apply_step(t, "fix_typos", "type_typo", {"mapping": mapping}), "type_typo")


@query("text_replace",
       "SELECT rid, CASE WHEN event_type = 'view' THEN 'page_view' ELSE event_type END AS event_type FROM ev_dirty", EV)
def text_replace(spark, sf):
    t = _step(spark, sf, "ev_dirty", "replace_value", "event_type", {"old": "view", "new": "page_view"})
    return out(t, "event_type")


@query("text_replace_numeric",
       "SELECT rid, CASE WHEN user_id = 8 THEN 800 ELSE user_id END AS user_id FROM ev_dirty", EV)
def text_replace_numeric(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "replace_value", "user_id", {"old": "8", "new": "800"}), "user_id")


# -- cell patches --------------------------------------------------------------------------------------------------
@query("join_patch_cells",
       "WITH p AS (SELECT rid, max(CASE WHEN col = 'value' THEN 1 END) AS hv, "
       "max(CASE WHEN col = 'value' THEN new_value END) AS v, max(CASE WHEN col = 'event_type' THEN 1 END) AS he, "
       "max(CASE WHEN col = 'event_type' THEN new_value END) AS e FROM cell_patches GROUP BY rid) "
       f"SELECT d.rid, CASE WHEN p.hv = 1 THEN {S.num('p.v')} ELSE d.value END AS value, "
       "CASE WHEN p.he = 1 THEN nullif(p.e, '') ELSE d.event_type END AS event_type "
       "FROM ev_dirty d LEFT JOIN p ON d.rid = p.rid", ("ev_dirty", "cell_patches"))
def join_patch_cells(spark, sf):
    t = fixture(spark, sf, "ev_dirty")
    p = fixture_df(spark, sf, "cell_patches").select(
        F.col("rid").alias(RID), F.col("col").alias("column"), F.col("new_value").alias("value"))
    return out(apply_patches(t, p), "value", "event_type")


# -- ordered steps ------------------------------------------------------------------------------------------------
def _sorted(spark, sf, steps):
    r = Recipe(fixture(spark, sf, "ev_dirty"))
    for s in steps:
        r = r.append(s)
    return r.result


def _pos_out(t, *cols):
    return t.positions("pos").select(F.col(RID).alias("rid"), *cols, "pos")


@query("sort_asc", "SELECT rid, value, row_number() OVER (ORDER BY value ASC NULLS LAST, rid) - 1 AS pos FROM ev_dirty", EV)
def sort_asc(spark, sf):
    return _pos_out(_sorted(spark, sf, [Step("sort_values", "value", {"direction": "asc"})]), "value")


@query("sort_desc", "SELECT rid, value, row_number() OVER (ORDER BY value DESC NULLS LAST, rid) - 1 AS pos FROM ev_dirty", EV)
def sort_desc(spark, sf):
    return _pos_out(_sorted(spark, sf, [Step("sort_values", "value", {"direction": "desc"})]), "value")


@query("sort_default", "SELECT rid, value, row_number() OVER (ORDER BY rid) - 1 AS pos FROM ev_dirty", EV)
def sort_default(spark, sf):
    return _pos_out(_sorted(spark, sf, [Step("sort_values", "value", {"direction": "desc"}),
                                        Step("sort_values", None, {"direction": "default"})]), "value")


@query("sort_stable",
       "SELECT rid, event_type, value, row_number() OVER (ORDER BY value DESC NULLS LAST, event_type ASC NULLS LAST, rid) - 1 "
       "AS pos FROM ev_dirty", EV)
def sort_stable(spark, sf):
    t = _sorted(spark, sf, [Step("sort_values", "event_type", {"direction": "asc"}),
                            Step("sort_values", "value", {"direction": "desc"})])
    return _pos_out(t, "event_type", "value")


_TS_TEXT = ("CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') "
            "ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END")


@query("src_slice_deep",
       f"SELECT rid, value, {_TS_TEXT} AS ts, pos FROM (SELECT *, row_number() OVER (ORDER BY value DESC NULLS LAST, rid) - 1 AS pos "
       "FROM ev_dirty) WHERE pos >= 300 AND pos < 350", EV)
def src_slice_deep(spark, sf):
    """The path of deep pages: positions looked up instead of a large top-k."""
    t = _sorted(spark, sf, [Step("sort_values", "value", {"direction": "desc"})])
    return slice_rows(t, page=6, size=50, pos="pos", top_k_max=0).select(F.col(RID).alias("rid"), "value", "ts", "pos")


@query("src_slice_fence",
       f"SELECT rid, value, {_TS_TEXT} AS ts, pos FROM (SELECT *, row_number() OVER (ORDER BY type_case DESC NULLS LAST, value NULLS LAST, rid) - 1 AS pos "
       "FROM ev_dirty) WHERE pos >= 300 AND pos < 350 OR pos >= 600 AND pos < 650", EV)
def src_slice_fence(spark, sf):
    """Two deep pages of one order over two keys: positions are staged once as fences, each page reads its range."""
    t = _sorted(spark, sf, [Step("sort_values", "value"), Step("sort_values", "type_case", {"direction": "desc"})])
    fences = fence_index(t, every=128)
    pages = [slice_rows(t, page=p, size=50, pos="pos", fences=fences).select(F.col(RID).alias("rid"), "value", "ts", "pos") for p in (6, 12)]
    return pages[0].unionByName(pages[1])


@query("src_slice_marks",
       f"SELECT rid, type_pad, CASE WHEN rid % 4 = 0 THEN 'type_pad' ELSE '' END AS changed FROM (SELECT rid, {S.strip('type_pad')} AS type_pad "
       "FROM ev_dirty) ORDER BY rid LIMIT 60 OFFSET 60", EV)
def src_slice_marks(spark, sf):
    """A page with the columns that the last step changed in each of its rows."""
    before = fixture(spark, sf, "ev_dirty")
    after = apply_step(before, "trim_whitespace", "type_pad")
    page = slice_rows(after, page=1, size=60, changed=diff_cells(before, after))
    return page.select(F.col(RID).alias("rid"), "type_pad", F.array_join("_changed", ",").alias("changed"))


@query("src_slice",
       f"SELECT rid, value, {_TS_TEXT} AS ts FROM ev_dirty "
       "ORDER BY value DESC NULLS LAST, rid LIMIT 100 OFFSET 200", EV)
def src_slice(spark, sf):
    t = _sorted(spark, sf, [Step("sort_values", "value", {"direction": "desc"})])
    return slice_rows(t, page=2, size=100).select(F.col(RID).alias("rid"), "value", "ts")


@query("win_ffill",
       "SELECT rid, last_value(value_sparse IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
       "AS value_sparse FROM ev_dirty", EV)
def win_ffill(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "fill_missing", "value_sparse", {"method": "ffill"}), "value_sparse")


@query("win_bfill",
       "SELECT rid, first_value(value_sparse IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) "
       "AS value_sparse FROM ev_dirty", EV)
def win_bfill(spark, sf):
    return out(_step(spark, sf, "ev_dirty", "fill_missing", "value_sparse", {"method": "bfill"}), "value_sparse")


@query("win_ffill_sparse_key",
       "SELECT rid, last_value(value IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM ev_sparse",
       ("ev_sparse",))
def win_ffill_sparse_key(spark, sf):
    """Row ids with a huge gap: blocks hold rows, not key ranges."""
    return out(_step(spark, sf, "ev_sparse", "fill_missing", "value", {"method": "ffill"}), "value")


@query("win_ffill_sorted",
       "SELECT rid, user_id, last_value(value_sparse IGNORE NULLS) OVER (ORDER BY user_id NULLS LAST, rid "
       "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value_sparse FROM ev_dirty", EV)
def win_ffill_sorted(spark, sf):
    t = _sorted(spark, sf, [Step("sort_values", "user_id", {"direction": "asc"}),
                            Step("fill_missing", "value_sparse", {"method": "ffill"})])
    return out(t, "user_id", "value_sparse")


@query("win_dedup_first",
       "SELECT min(rid) AS rid, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority "
       "FROM ord_dups GROUP BY ALL", ("ord_dups",))
def win_dedup_first(spark, sf):
    return out(_step(spark, sf, "ord_dups", "remove_duplicates"))
