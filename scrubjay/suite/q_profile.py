"""Profile (P1-P8) and quality (Q1-Q12) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubjay.functions.exprs import round_half_away

from scrubjay.operators import profile as P
from scrubjay.operators import quality as Q
from scrubjay.plans.recipe import Recipe
from scrubjay.plans.table import RID, Table
from scrubjay.suite import sqlgen as G
from scrubjay.suite.base import fixture, fixture_df, loaded, query, table
from scrubjay.suite.q_steps import EV_COLS

EV = ("ev_dirty",)
EV_NUM = ["user_id", "value", "value_sparse"]
EV_STR = ["num_text", "type_case", "type_pad", "type_typo", "event_type", "date_text"]
EV_OTHER = ["ts"] + EV_STR


# -- P1 / P2 -------------------------------------------------------------------------------------
@query("prof_nulls", G.union([
    f"SELECT '{c}' AS column, count(*) - count({c}) AS null_count, "
    f"round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct FROM ev_dirty" for c in EV_COLS]), EV)
def prof_nulls(spark, sf):
    return P.column_stats(fixture(spark, sf, "ev_dirty"), distinct=False).select("column", "null_count", "null_pct")


@query("prof_distinct", G.union([
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS unique_count, "
    f"round(count(DISTINCT {c}) / count(*) * 100, 0) AS distinct_pct FROM ev_dirty" for c in EV_COLS]), EV)
def prof_distinct(spark, sf):
    return P.column_stats(fixture(spark, sf, "ev_dirty")).select("column", "unique_count", "distinct_pct")


# -- P3 ---------------------------------------------------------------------------------------------
@query("prof_numeric", G.union([
    f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
    f"round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, "
    f"round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS median, "
    f"round(quantile_cont({c}, 0.75), 4) AS q75 FROM ev_dirty" for c in EV_NUM]), EV)
def prof_numeric(spark, sf):
    return P.numeric_summary(fixture(spark, sf, "ev_dirty"))


PART_CAT = ["p_name", "p_brand", "p_type"]


@query("prof_top_values",
       "SELECT * FROM (SELECT column, value, count, row_number() OVER (PARTITION BY column ORDER BY count DESC, value) AS rank "
       "FROM (" + G.union([f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM part "
                           f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in PART_CAT]) + ")) WHERE rank <= 5")
def prof_top_values(spark, sf):
    t = Table.from_df(table(spark, sf, "part"), rid="p_partkey")
    return P.top_values(t).withColumn("rank", F.col("rank").cast("long"))


# -- P5 -----------------------------------------------------------------------------------------------
@query("prof_histogram", G.histogram("ev_dirty", "value", "greatest(1, least(24, d))"), EV)
def prof_histogram(spark, sf):
    return P.histogram(fixture(spark, sf, "ev_dirty"), "value")


@query("prof_all_histograms", " UNION ALL ".join(
    f"SELECT * FROM ({G.histogram('ev_dirty', c, 'greatest(1, least(24, d))')})" for c in EV_NUM), EV)
def prof_all_histograms(spark, sf):
    return P.histograms(fixture(spark, sf, "ev_dirty"))


@query("prof_top_values_all",
       "SELECT * FROM (SELECT column, value, count, row_number() OVER (PARTITION BY column ORDER BY count DESC, value) AS rank "
       "FROM (" + G.union([f"SELECT '{c}' AS column, {c} AS value, count(*) AS count FROM ev_dirty "
                           f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in EV_STR]) + ")) WHERE rank <= 5", EV)
def prof_top_values_all(spark, sf):
    return P.top_values(fixture(spark, sf, "ev_dirty"), EV_STR).withColumn("rank", F.col("rank").cast("long"))


@query("prof_top_values_unique", " UNION ALL ".join(
       f"SELECT * FROM (SELECT '{c}' AS column, {c} AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank "
       f"FROM documents WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5" for c in ("text", "lang", "source")))
def prof_top_values_unique(spark, sf):
    """Top values of long texts that seldom repeat (and of two short columns): counts by hash first."""
    return P.top_values_by_hash(loaded(spark, sf, "documents"), ["text", "lang", "source"]).withColumn("rank", F.col("rank").cast("long"))


@query("prof_histogram_discrete", G.histogram("lineitem", "l_discount", "greatest(1, least(24, d))"))
def prof_histogram_discrete(spark, sf):
    li = table(spark, sf, "lineitem").select("l_discount").withColumn(RID, F.lit(0).cast("long"))
    return P.histogram(Table(li), "l_discount")


@query("prof_histogram_trim", G.histogram("ev_dirty", "value_sparse", "greatest(1, least(24, d))", trim=True), EV)
def prof_histogram_trim(spark, sf):
    return P.trim_bins(P.histogram(fixture(spark, sf, "ev_dirty"), "value_sparse"))


# -- P6 -------------------------------------------------------------------------------------------------
BOX_SQL = """
WITH q AS (SELECT min(value) AS mn, max(value) AS mx, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
                  quantile_cont(value, 0.75) AS q3 FROM ev_dirty),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT 'value' AS column, round(mn, 4) AS min, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3,
       round(mx, 4) AS max,
       round(coalesce((SELECT min(value) FROM ev_dirty WHERE value >= f.lo AND value <= f.hi), q1), 4) AS whisk_lo,
       round(coalesce((SELECT max(value) FROM ev_dirty WHERE value >= f.lo AND value <= f.hi), q3), 4) AS whisk_hi,
       (SELECT count(*) FROM ev_dirty WHERE value < f.lo OR value > f.hi) AS n_outliers
FROM f
"""


@query("prof_box", BOX_SQL, EV)
def prof_box(spark, sf):
    return P.box_summary(fixture(spark, sf, "ev_dirty"), "value")[0]


BOX_ALL_SQL = " UNION ALL ".join(
    "SELECT * FROM (" + BOX_SQL.replace("(value", f"({c}").replace("value >=", f"{c} >=").replace("value <", f"{c} <")
    .replace("value >", f"{c} >").replace("'value'", f"'{c}'") + ")" for c in EV_NUM)


@query("prof_box_all", BOX_ALL_SQL, EV)
def prof_box_all(spark, sf):
    return P.box_summaries(fixture(spark, sf, "ev_dirty"))


@query("qual_outlier_boxes", "SELECT b.* FROM (" + BOX_ALL_SQL + ") b WHERE b.n_outliers > 0", EV)
def qual_outlier_boxes(spark, sf):
    return Q.outlier_boxes(fixture(spark, sf, "ev_dirty"))


BOX_POINTS_SQL = """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ev_dirty)
SELECT 'value' AS column, rid AS _rid, round(value, 4) AS value FROM ev_dirty, q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) ORDER BY md5(CAST(rid AS VARCHAR)), rid LIMIT 40
"""


@query("prof_box_points", BOX_POINTS_SQL, EV)
def prof_box_points(spark, sf):
    """Deterministic sample of at most 40 outlier points (the sample is the feature)."""
    return P.box_summary(fixture(spark, sf, "ev_dirty"), "value")[1]


# -- P7 / P8 ----------------------------------------------------------------------------------------------
@query("prof_skew", G.union([f"SELECT '{c}' AS column, {G.skew_expr(c)} AS skew FROM ev_dirty" for c in EV_NUM]), EV)
def prof_skew(spark, sf):
    return P.skew(fixture(spark, sf, "ev_dirty"))


ORD_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("prof_summary",
       f"SELECT count(*) AS total_rows, CAST(6 AS BIGINT) AS total_cols, CAST(0 AS BIGINT) AS total_missing, "
       f"({G.duplicates('ord_dups', ORD_COLS)}) AS duplicates FROM ord_dups", ("ord_dups",))
def prof_summary(spark, sf):
    return P.dataset_summary(fixture(spark, sf, "ord_dups"))


@query("prof_summary_missing",
       "SELECT count(*) AS total_rows, CAST(10 AS BIGINT) AS total_cols, CAST("
       + " + ".join(f"(count(*) - count({c}))" for c in EV_COLS) + " AS BIGINT) AS total_missing, "
       f"({G.duplicates('ev_dirty', EV_COLS)}) AS duplicates FROM ev_dirty", EV)
def prof_summary_missing(spark, sf):
    return P.dataset_summary(fixture(spark, sf, "ev_dirty"))


# -- quality ------------------------------------------------------------------------------------------------
@query("qual_missing", G.missing("ev_dirty", EV_NUM, EV_OTHER), EV)
def qual_missing(spark, sf):
    return Q.missing(fixture(spark, sf, "ev_dirty")).drop("reason")


@query("qual_duplicates", G.duplicates("ord_dups", ORD_COLS), ("ord_dups",))
def qual_duplicates(spark, sf):
    return P.duplicate_count(fixture(spark, sf, "ord_dups"))


@query("qual_type_numeric", G.type_issues("ev_dirty", EV_STR), EV)
def qual_type_numeric(spark, sf):
    return Q.type_issues(fixture(spark, sf, "ev_dirty"))


ODT = "(SELECT rid, CAST(odate AS VARCHAR) AS odate_text, status, priority FROM ord_holes)"


@query("qual_type_datetime", G.type_issues(ODT, ["odate_text", "status", "priority"]), ("ord_holes",))
def qual_type_datetime(spark, sf):
    df = fixture_df(spark, sf, "ord_holes").select(
        "rid", F.col("odate").cast("string").alias("odate_text"), "status", "priority")
    return Q.type_issues(Table.from_df(df, rid="rid"))


@query("qual_outliers", G.outliers("ev_dirty", EV_NUM), EV)
def qual_outliers(spark, sf):
    return Q.outliers(fixture(spark, sf, "ev_dirty")).drop("reason")


@query("qual_recommend_outlier", G.outliers("documents", ["doc_id", "n_chars"]))
def qual_recommend_outlier(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars").withColumn(RID, F.col("doc_id"))
    return Q.outliers(Table(docs)).drop("reason")


OH_NUM, OH_OTHER = ["price"], ["priority", "status", "odate"]


@query("qual_recommend_fill",
       "SELECT column, method, skew FROM (" + G.missing("ord_holes", OH_NUM, OH_OTHER) + ")", ("ord_holes",))
def qual_recommend_fill(spark, sf):
    return Q.missing(fixture(spark, sf, "ord_holes")).select("column", "method", "skew")


@query("qual_date_formats", G.date_formats("ev_dirty", EV_STR), EV)
def qual_date_formats(spark, sf):
    return Q.date_formats(fixture(spark, sf, "ev_dirty"))


@query("qual_casing", G.casing("ev_dirty", EV_STR), EV)
def qual_casing(spark, sf):
    return Q.casing(fixture(spark, sf, "ev_dirty"))


# Each misspelling lacks the last letter of a type of n letters: the matching ratio is 2 (n - 1) / (2 n - 1).
@query("qual_typos",
       "WITH w AS (SELECT type_typo, count(*) AS n FROM ev_dirty GROUP BY type_typo) "
       "SELECT 'type_typo' AS column, b.type_typo AS value, g.type_typo AS match, "
       "round(2.0 * length(b.type_typo) / (2 * length(b.type_typo) + 1), 4) AS score, b.n AS value_count, g.n AS match_count "
       "FROM w b JOIN w g ON b.type_typo = substr(g.type_typo, 1, length(g.type_typo) - 1) "
       "WHERE b.n < g.n AND 2.0 * length(b.type_typo) / (2 * length(b.type_typo) + 1) >= 0.85", EV)
def qual_typos(spark, sf):
    """The matching ratio of ``difflib``; also checked against brute force in tests."""
    return Q.typo_candidates(fixture(spark, sf, "ev_dirty"), ["type_typo"]) \
        .withColumn("score", round_half_away(F.col("score"), 4))


@query("qual_typos_lev", G.typos_lev("ev_dirty", EV_STR), EV)
def qual_typos_lev(spark, sf):
    return Q.typo_candidates(fixture(spark, sf, "ev_dirty"), EV_STR, metric="levenshtein") \
        .withColumn("score", round_half_away(F.col("score"), 4))


@query("qual_typo_mapping",
       "WITH w AS (SELECT word, count(*) AS n FROM typo_many GROUP BY word) "
       "SELECT 'word' AS column, b.word AS value, g.word AS match FROM w b JOIN w g ON b.word = substr(g.word, 1, length(g.word) - 1) "
       "WHERE b.n < g.n", ("typo_many",))
def qual_typo_mapping(spark, sf):
    """Every pair of the typo findings (default metric), however many."""
    t = fixture(spark, sf, "typo_many")
    return Q.typo_mapping(Q.findings(t.with_df(t.df.drop("full_word"))))


@query("qual_fix_typo_step", "SELECT rid, full_word AS word FROM typo_many", ("typo_many",))
def qual_fix_typo_step(spark, sf):
    """The findings' plan as steps, the typo step applied."""
    t = fixture(spark, sf, "typo_many")
    t = t.with_df(t.df.drop("full_word"))
    steps = [s for s in Q.fix_steps(Q.findings(t)) if s.type == "fix_typos"]
    return Recipe(t, tuple(steps)).result.df.select(F.col(RID).alias("rid"), "word")


FINDINGS_SQL = G.findings("ev_dirty", EV_NUM, EV_OTHER, EV_STR, EV_COLS)


def _findings(spark, sf, suppress=()):
    t = fixture(spark, sf, "ev_dirty")
    return t, Q.findings(t, suppress=suppress, typo_metric="levenshtein", persist=True)


@query("qual_findings", "SELECT * FROM (" + FINDINGS_SQL + ")", EV)
def qual_findings(spark, sf):
    return _findings(spark, sf)[1].select("section", "column", "severity", "count")


SUPPRESS = (("missing", "value"), ("outliers", "value"))


@query("qual_findings_suppressed",
       "SELECT * FROM (" + FINDINGS_SQL + ") WHERE NOT ((section = 'missing' AND column = 'value') "
       "OR (section = 'outliers' AND column = 'value'))", EV)
def qual_findings_suppressed(spark, sf):
    return _findings(spark, sf, SUPPRESS)[1].select("section", "column", "severity", "count")


_CTES = G.findings_ctes("ev_dirty", EV_NUM, EV_OTHER, EV_STR, EV_COLS)


@query("qual_column_status",
       f"WITH {_CTES}, fd AS ({G.FINDINGS_SELECT}), cols AS ("
       + G.union([f"SELECT '{c}' AS column" for c in EV_COLS]) + ") "
       "SELECT column, CASE WHEN column IN (SELECT column FROM mi WHERE pct > 30) THEN 'error' "
       "WHEN column IN (SELECT column FROM fd) THEN 'warn' ELSE 'ok' END AS status FROM cols", EV)
def qual_column_status(spark, sf):
    t, fd = _findings(spark, sf)
    return Q.column_status(t, fd).select("column", "status")


@query("qual_fix_plan",
       f"WITH {_CTES}, fd AS ({G.FINDINGS_SELECT}) "
       "SELECT section, column, CASE section WHEN 'missing' THEN 'fill_missing' WHEN 'duplicates' THEN 'remove_duplicates' "
       "WHEN 'type_issues' THEN 'convert_type' WHEN 'outliers' THEN 'handle_outliers' "
       "WHEN 'typo_candidates' THEN 'fix_typos' ELSE "
       "(CASE WHEN column IN (SELECT column FROM fo) THEN 'standardize_date' ELSE 'standardize_case' END) END AS operation, "
       "CASE section WHEN 'missing' THEN (SELECT method FROM mi WHERE mi.column = fd.column) "
       "WHEN 'outliers' THEN (SELECT method FROM ou WHERE ou.column = fd.column) "
       "WHEN 'type_issues' THEN (SELECT suggested FROM ty WHERE ty.column = fd.column) END AS method "
       "FROM fd", EV)
def qual_fix_plan(spark, sf):
    return Q.fix_plan(_findings(spark, sf)[1])


@query("qual_missing_dist",
       "SELECT * FROM (" + G.histogram("ev_dirty", "value", "greatest(1, least(24, d))") + ") UNION ALL SELECT * FROM ("
       + G.histogram("ev_dirty", "value_sparse", "greatest(1, least(24, d))") + ")", EV)
def qual_missing_dist(spark, sf):
    return Q.missing_histograms(fixture(spark, sf, "ev_dirty"))


def _profile_sql(c):
    fam = "num" if c in EV_NUM else ("dt" if c == "ts" else "str")
    base = (f"SELECT '{c}' AS column, '{fam}' AS dtype, count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct, count(DISTINCT {c}) AS unique_count, "
            f"round(count(DISTINCT {c}) / count(*) * 100, 0) AS distinct_pct, ")
    if c in EV_NUM:
        return base + (f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
                       f"round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, "
                       f"round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS median, "
                       f"round(quantile_cont({c}, 0.75), 4) AS q75 FROM ev_dirty")
    return base + ", ".join(f"CAST(NULL AS DOUBLE) AS {k}" for k in
                            ("mean", "std", "min", "max", "q25", "median", "q75")) + " FROM ev_dirty"


@query("prof_column_profile", G.union([_profile_sql(c) for c in EV_COLS]), EV)
def prof_column_profile(spark, sf):
    return P.column_profile(fixture(spark, sf, "ev_dirty"))


# -- P1 to P5 in one call: stats, bins and top values as rows -----------------------------------------
@query("prof_panel", " UNION ALL ".join(
    [f"SELECT column, 'stats' AS part, 0 AS place, CAST(NULL AS VARCHAR) AS label, median AS lo, q75 AS hi, unique_count AS count FROM ({_profile_sql(c)})"
     for c in EV_NUM + EV_STR]
    + [f"SELECT column, 'bin' AS part, bin AS place, CAST(NULL AS VARCHAR) AS label, bin_lo AS lo, bin_hi AS hi, count "
       f"FROM ({G.histogram('ev_dirty', c, 'greatest(1, least(24, d))')})" for c in EV_NUM]
    + ["SELECT column, 'top' AS part, CAST(rank AS INTEGER) AS place, value AS label, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, count FROM ("
       "SELECT column, value, count, row_number() OVER (PARTITION BY column ORDER BY count DESC, value) AS rank "
       "FROM (" + G.union([f"SELECT '{c}' AS column, {c} AS value, count(*) AS count FROM ev_dirty "
                           f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in EV_STR]) + ")) WHERE rank <= 5"]), EV)
def prof_panel(spark, sf):
    panel = P.column_panel(fixture(spark, sf, "ev_dirty"), EV_NUM + EV_STR)
    none = F.lit(None)
    stats = panel.select("column", F.lit("stats").alias("part"), F.lit(0).alias("place"), none.cast("string").alias("label"),
                         F.col("median").alias("lo"), F.col("q75").alias("hi"), F.col("unique_count").alias("count"))
    bins = (panel.select("column", F.explode("bins").alias("b"))
            .select("column", F.lit("bin"), "b.bin", none.cast("string"), "b.bin_lo", "b.bin_hi", "b.count"))
    top = (panel.select("column", F.explode("top").alias("v"))
           .select("column", F.lit("top"), "v.rank", "v.value", none.cast("double"), none.cast("double"), "v.count"))
    return stats.unionAll(bins).unionAll(top)
