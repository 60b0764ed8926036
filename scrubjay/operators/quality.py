"""Quality findings (Q1-Q12).

``scan(table)`` gathers every per-column count in bounded-width aggregates of
plain counts (nulls, numeric/date convertibility, date-pattern and casing
counts) plus two-pass moments for skewness; date parsing runs only on columns
that can pass the date test.  The quartiles for the outlier rule come from the
shared exact-quantile passes and the outlier counts from one more aggregate.
Duplicates are a grouped count.  Typo candidates compare each distinct value
with the 30 most frequent others of low-cardinality text columns only (a
HyperLogLog pre-check skips the rest), so the pair frame is bounded by
200 x 30 per column whatever the table size.  ``findings`` submits the three
independent chains (column sections, duplicates, typos) concurrently.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubjay.functions.dates import DATE_CLASSES, DATE_TEXT_PATTERNS, class_counts, date_class
from scrubjay.functions.moments import agg_dict, power_sums, skew_from
from scrubjay.functions.exprs import (col, is_numeric_type, is_string_type, is_lower, is_title,
                                      is_upper, pround, to_num)
from scrubjay.functions.quantiles import quantiles, value_stats
from scrubjay.plans.table import Table
from scrubjay.operators.profile import BOX_SCHEMA, HISTOGRAM_SCHEMA, box_summaries, duplicate_count, histograms
from scrubjay.session import staged

# Rule thresholds of the quality report.
TYPE_RATIO = 0.7
CASING_DOMINANT = 0.8
CASING_MIN_VALUES = 10
OUTLIER_MIN_VALUES = 4
TYPO_MIN_DISTINCT, TYPO_MAX_DISTINCT = 3, 200
TYPO_CANDIDATES = 30
TYPO_CUTOFF = 0.85
SKEW_SYMMETRIC = 0.5
SKEW_HEAVY = 1.0
OUTLIER_CAP_PCT = 5.0
MISSING_HIGH, MISSING_MED = 30.0, 10.0


@dataclass
class Scan:
    rows: int
    columns: list
    nulls: dict = field(default_factory=dict)
    nonnull: dict = field(default_factory=dict)
    skew: dict = field(default_factory=dict)
    numeric_ok: dict = field(default_factory=dict)
    date_ok: dict = field(default_factory=dict)
    patterns: dict = field(default_factory=dict)
    casing: dict = field(default_factory=dict)
    stats: dict = field(default_factory=dict)


def scan(t: Table, text: bool = True) -> Scan:
    """Every per-column count the detectors need, as plain counts in
    bounded-width aggregates, plus two-pass moments for skewness.
    ``text=False`` skips the text checks (type, format, casing findings)."""
    num = [c for c in t.columns if is_numeric_type(t.dtype(c))]
    txt = [c for c in t.columns if is_string_type(t.dtype(c))] if text else []
    items = [("rows", F.count(F.lit(1)), 1)]
    for i, c in enumerate(t.columns):
        items.append((f"nn{i}", F.count(col(c)), 1))
    for i, c in enumerate(txt):
        s = col(c)
        items.append((f"num{i}", F.count(to_num(s, T.StringType())), 1))
        items.append((f"dig{i}", F.count(F.when(s.rlike(r"\d"), 1)), 1))
        for k, (_, pat) in enumerate(DATE_TEXT_PATTERNS):
            items.append((f"p{i}_{k}", F.count(F.when(s.rlike(pat), 1)), 1))
        items += [(f"lo{i}", F.count(F.when(is_lower(s), 1)), 1),
                  (f"up{i}", F.count(F.when(is_upper(s), 1)), 1),
                  (f"ti{i}", F.count(F.when(is_title(s), 1)), 1)]
    row = agg_dict(t.df, items)
    # the date test only matters where the numeric test failed, and every date
    # format needs digits: parse only columns where 70% of values have one
    dated = [(i, c) for i, c in enumerate(txt)
             if row[f"nn{t.columns.index(c)}"]
             and row[f"num{i}"] / row[f"nn{t.columns.index(c)}"] < TYPE_RATIO
             and row[f"dig{i}"] / row[f"nn{t.columns.index(c)}"] >= TYPE_RATIO]
    # a value is classed and parsed once, below the counts of its class
    classed = t.df.select(*[date_class(col(c)).alias(f"c{i}") for i, c in dated])
    dts = agg_dict(classed, [(f"dt{i}_{k}", F.count(F.when(F.col(f"c{i}") == k, 1)), 1) for i, _ in dated for k in DATE_CLASSES]) if dated else {}
    sc = Scan(rows=row["rows"], columns=list(t.columns))
    for i, c in enumerate(t.columns):
        sc.nonnull[c] = row[f"nn{i}"]
        sc.nulls[c] = row["rows"] - row[f"nn{i}"]
    sc.stats, _ = value_stats(t.df, [(c, col(c), None) for c in num], [0.25, 0.75])
    powers = power_sums(t.df, {c: col(c).cast("double") for c in num}, {c: s.mean for c, s in sc.stats.items()})
    for c, s in sc.stats.items():
        sc.skew[c] = skew_from({"n": s.n, "min": s.lo, "max": s.hi, **powers[c]})
    for i, c in enumerate(txt):
        sc.numeric_ok[c] = row[f"num{i}"]
        sc.date_ok[c] = max(class_counts({k: dts.get(f"dt{i}_{k}", 0) for k in DATE_CLASSES}))
        sc.patterns[c] = {name: row[f"p{i}_{k}"] for k, (name, _) in enumerate(DATE_TEXT_PATTERNS)}
        sc.casing[c] = (row[f"lo{i}"], row[f"up{i}"], row[f"ti{i}"])
    return sc


def _side(sk):
    return "right" if sk > 0 else "left"


# -- Q8 / Q9 --------------------------------------------------------------------------------
def recommend_fill(is_numeric: bool, nonnull: int, sk: float):
    if not is_numeric:
        return "mode", "categorical column: the most frequent value fills the gaps"
    if not nonnull:
        return "zero", "no values at all: there is no distribution to take a centre from"
    if abs(sk) <= SKEW_SYMMETRIC:
        return "mean", f"near symmetric (skew {sk:+.2f}): the mean is a fair centre"
    return "median", f"{_side(sk)}-skewed (skew {sk:+.2f}): the median resists the long tail"


def recommend_outlier(pct: float, sk: float):
    if pct > OUTLIER_CAP_PCT:
        return "cap", f"{pct}% of rows are outliers: capping keeps every row"
    if abs(sk) > SKEW_HEAVY:
        return "cap", f"heavily {_side(sk)}-skewed (skew {sk:+.2f}): the tail may be real, cap it"
    return "remove", f"few outliers ({pct}%) and skew {sk:+.2f}: removing them is safe"


def missing_severity(pct: float) -> str:
    return "HIGH" if pct > MISSING_HIGH else "MED" if pct > MISSING_MED else "LOW"


# -- Q1 ------------------------------------------------------------------------------------------
MISSING_SCHEMA = "column string, count long, pct double, severity string, method string, skew double, reason string"


def missing_rows(t: Table, sc: Scan | None = None) -> list:
    sc = sc or scan(t, text=False)
    out = []
    for c in t.columns:
        n = sc.nulls[c]
        if not n:
            continue
        pct = pround(n / sc.rows * 100, 2)
        is_num = is_numeric_type(t.dtype(c))
        sk = sc.skew.get(c, 0.0) if is_num else None
        method, reason = recommend_fill(is_num, sc.nonnull[c], sk or 0.0)
        out.append((c, n, pct, missing_severity(pct), method, sk, reason))
    return out


def missing(t: Table, sc: Scan | None = None) -> DataFrame:
    return t.df.sparkSession.createDataFrame(missing_rows(t, sc), MISSING_SCHEMA)


def missing_histograms(t: Table, sc: Scan | None = None) -> DataFrame:
    """The distribution shown with each numeric missing-value finding (at
    least 3 values): the profile histogram (P5) of those columns, stacked."""
    sc = sc or scan(t, text=False)
    cols = [c for c in t.columns if is_numeric_type(t.dtype(c)) and sc.nulls[c] and sc.nonnull[c] >= 3]
    return histograms(t, cols) if cols else t.df.sparkSession.createDataFrame([], HISTOGRAM_SCHEMA)


# -- Q3 ------------------------------------------------------------------------------------------
TYPE_SCHEMA = "column string, current string, suggested string, convertible long, convertible_pct double"


def type_issues_rows(t: Table, sc: Scan | None = None) -> list:
    sc = sc or scan(t)
    out = []
    for c, ok in sc.numeric_ok.items():
        n = sc.nonnull[c]
        if not n:
            continue
        if ok / n >= TYPE_RATIO:
            out.append((c, "string", "numeric", ok, pround(ok / n * 100, 2)))
        elif sc.date_ok[c] / n >= TYPE_RATIO:
            d = sc.date_ok[c]
            out.append((c, "string", "datetime", d, pround(d / n * 100, 2)))
    return out


def type_issues(t: Table, sc: Scan | None = None) -> DataFrame:
    return t.df.sparkSession.createDataFrame(type_issues_rows(t, sc), TYPE_SCHEMA)


# -- Q4 ------------------------------------------------------------------------------------------
OUTLIER_SCHEMA = ("column string, count long, pct double, lower_bound double, upper_bound double, "
                  "severity string, method string, skew double, reason string")


def outlier_bounds(t: Table, sc: Scan, method: str = "exact") -> dict:
    cands = [c for c in t.columns if is_numeric_type(t.dtype(c)) and sc.nonnull[c] >= OUTLIER_MIN_VALUES]
    qs = quantiles(t.df, [(c, col(c), None) for c in cands], [0.25, 0.75], method=method, stats={c: sc.stats[c] for c in cands})
    out = {}
    for c in cands:
        q1, q3 = qs[c]
        iqr = q3 - q1
        out[c] = (q1 - 1.5 * iqr, q3 + 1.5 * iqr)
    return out


def outliers(t: Table, sc: Scan | None = None, method: str = "exact") -> DataFrame:
    return t.df.sparkSession.createDataFrame(outliers_rows(t, sc, method), OUTLIER_SCHEMA)


def outliers_rows(t: Table, sc: Scan | None = None, method: str = "exact") -> list:
    sc = sc or scan(t, text=False)
    bounds = outlier_bounds(t, sc, method)
    if not bounds:
        return []
    names = list(bounds)
    aggs = []
    for i, c in enumerate(names):
        lo, hi = bounds[c]
        v = col(c).cast("double")
        aggs.append(F.count(F.when((v < F.lit(lo)) | (v > F.lit(hi)), 1)).alias(f"o{i}"))
    row = t.df.agg(*aggs).first()
    out = []
    for i, c in enumerate(names):
        n_out = row[f"o{i}"]
        if not n_out:
            continue
        lo, hi = bounds[c]
        pct = pround(n_out / sc.rows * 100, 2)
        sk = sc.skew[c]
        m, reason = recommend_outlier(pct, sk)
        out.append((c, n_out, pct, pround(lo, 4), pround(hi, 4), "HIGH" if pct > OUTLIER_CAP_PCT else "MED",
                    m, sk, reason))
    return out


def outlier_boxes(t: Table, found: DataFrame | None = None, method: str = "exact") -> DataFrame:
    """The box summary shown beside each outlier finding, one row per column with one."""
    found = found or outliers(t, method=method)
    columns = [r["column"] for r in found.select("column").collect()]
    return box_summaries(t, columns, method) if columns else t.df.sparkSession.createDataFrame([], BOX_SCHEMA)


# -- Q5 / Q6 ------------------------------------------------------------------------------------------
DATE_FMT_SCHEMA = "column string, format string, count long"
CASING_SCHEMA = "column string, lower long, upper long, title long, mixed long"


def date_formats_rows(t: Table, sc: Scan | None = None) -> list:
    sc = sc or scan(t)
    out = []
    for c, found in sc.patterns.items():
        hit = {k: v for k, v in found.items() if v}
        if len(hit) > 1:
            out += [(c, k, v) for k, v in hit.items()]
    return out


def date_formats(t: Table, sc: Scan | None = None) -> DataFrame:
    return t.df.sparkSession.createDataFrame(date_formats_rows(t, sc), DATE_FMT_SCHEMA)


def casing_rows(t: Table, sc: Scan | None = None) -> list:
    sc = sc or scan(t)
    out = []
    for c, (lo, up, ti) in sc.casing.items():
        if sum(1 for v in sc.patterns[c].values() if v) > 1:
            continue  # reported as a date-format finding instead
        n = sc.nonnull[c]
        if n > CASING_MIN_VALUES and max(lo, up, ti) < n * CASING_DOMINANT:
            out.append((c, lo, up, ti, n - lo - up - ti))
    return out


def casing(t: Table, sc: Scan | None = None) -> DataFrame:
    return t.df.sparkSession.createDataFrame(casing_rows(t, sc), CASING_SCHEMA)


# -- Q7 ------------------------------------------------------------------------------------------------
@F.pandas_udf(T.DoubleType())
def difflib_ratio(candidate: pd.Series, value: pd.Series) -> pd.Series:
    """``SequenceMatcher(None, candidate, value).ratio()`` over a batch of pairs."""
    sm = difflib.SequenceMatcher(None)
    out = []
    for a, b in zip(candidate, value):
        sm.set_seq2(b)
        sm.set_seq1(a)
        out.append(sm.ratio())
    return pd.Series(out, dtype="float64")


TYPO_SCHEMA = "column string, value string, match string, score double, value_count long, match_count long"


def typo_candidates(t: Table, columns=None, metric: str = "difflib", cutoff: float = TYPO_CUTOFF) -> DataFrame:
    """Rare values that closely match one of the 30 most frequent other values.

    ``metric='difflib'``: the ``SequenceMatcher`` ratio (Arrow-batched UDF over
    the bounded pair frame); ``metric='levenshtein'``: ``1 - lev / max(len)``."""
    cols = [c for c in (columns or t.columns) if is_string_type(t.dtype(c))]
    spark = t.df.sparkSession
    if not cols:
        return spark.createDataFrame([], TYPO_SCHEMA)
    # a HyperLogLog estimate (standard error 5%) rules out columns far above 200
    # distinct values: twice the limit is 20 standard errors away from it; the
    # value counts of the rest (<= ~400 rows each) decide exactly
    approx = t.df.agg(*[F.approx_count_distinct(col(c)).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    near = [c for i, c in enumerate(cols) if approx[f"a{i}"] <= 2 * TYPO_MAX_DISTINCT]
    if not near:
        return spark.createDataFrame([], TYPO_SCHEMA)
    # value counts of all remaining columns in one pass: unpivot to (column, value)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in near]))
    vc = (t.df.select(pairs.alias("e")).select("e.column", "e.value").where(F.col("value").isNotNull())
          .groupBy("column", "value").agg(F.count("*").alias("n")))
    per_col = Window.partitionBy("column")  # bounded: <= ~400 rows per column
    vc = staged(vc.withColumn("d", F.count(F.lit(1)).over(per_col))
                .where((F.col("d") >= TYPO_MIN_DISTINCT) & (F.col("d") <= TYPO_MAX_DISTINCT))
                .drop("d"), "values")
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
    canon = (vc.withColumn("r", F.row_number().over(w)).where(F.col("r") <= TYPO_CANDIDATES)
             .select("column", F.col("value").alias("match"), F.col("n").alias("match_count")))
    pairs = vc.join(canon, "column").where(F.col("match") != F.col("value"))
    if metric == "levenshtein":
        score = 1 - F.levenshtein("value", "match") / F.greatest(F.length("value"), F.length("match"))
    else:
        # the ratio is at most 2 * shorter / (both lengths): exact, and spares the UDF hopeless pairs
        short, both = F.least(F.length("value"), F.length("match")), F.length("value") + F.length("match")
        pairs = pairs.where(2 * short >= F.lit(cutoff) * both)
        score = difflib_ratio(F.col("match"), F.col("value"))
    scored = pairs.withColumn("score", score.cast("double")).where(F.col("score") >= cutoff)
    best = scored.groupBy("column", "value").agg(
        F.max(F.struct("score", "match", "match_count", F.col("n").alias("value_count"))).alias("b"))
    return (best.select("column", "value", F.col("b.match").alias("match"), F.col("b.score").alias("score"),
                        F.col("b.value_count").alias("value_count"), F.col("b.match_count").alias("match_count"))
                .where(F.col("value_count") < F.col("match_count")))


# -- Q10 / Q11 / Q12 -----------------------------------------------------------------------------------------
FINDINGS_SCHEMA = ("section string, column string, severity string, count long, pct double, "
                   "detail string, method string, reason string, mapping map<string,string>")

# The step that fixes each kind of finding.
FIX_OPERATIONS = {
    "missing": "fill_missing",
    "duplicates": "remove_duplicates",
    "type_issues": "convert_type",
    "outliers": "handle_outliers",
    "inconsistent_formats:date_format": "standardize_date",
    "inconsistent_formats:casing": "standardize_case",
    "typo_candidates": "fix_typos",
}


def findings(t: Table, suppress=(), typo_metric: str = "difflib", method: str = "exact",
             persist: bool = False) -> DataFrame:
    """All sections as one long frame, minus suppressed ``(section, column)``
    keys (duplicates use column ``*``).

    The report makes several passes over the table; ``persist=True`` keeps
    the data columns (memory, spilling to disk) for the duration of the call."""
    if persist:
        from pyspark import StorageLevel
        kept = t.with_df(t.df.persist(StorageLevel.MEMORY_AND_DISK))
        try:
            # the report is built from collected aggregates, so the cache can go afterwards
            return _findings_rows_frame(kept, suppress, typo_metric, method)
        finally:
            kept.df.unpersist()
    return _findings_rows_frame(t, suppress, typo_metric, method)


def _findings_rows_frame(t: Table, suppress, typo_metric, method) -> DataFrame:
    from concurrent.futures import ThreadPoolExecutor
    spark = t.df.sparkSession

    def column_sections():
        sc = scan(t)
        return sc, missing_rows(t, sc), type_issues_rows(t, sc), outliers_rows(t, sc, method), \
            date_formats_rows(t, sc), casing_rows(t, sc)

    # three independent chains of jobs, submitted concurrently from the driver
    with ThreadPoolExecutor(max_workers=3) as pool:
        f_cols = pool.submit(column_sections)
        f_dups = pool.submit(lambda: duplicate_count(t).first()["duplicates"])
        f_typo = pool.submit(lambda: typo_candidates(t, metric=typo_metric).orderBy("column", "value").collect())
        sc, miss, types, outl, fmts, cases = f_cols.result()
        dups, typo_rows = f_dups.result(), f_typo.result()
    rows = []

    def add(section, column, severity, count, pct=None, detail=None, method=None, reason=None, mapping=None):
        rows.append((section, column, severity, count, pct, detail, method, reason, mapping))

    for c, n, pct, sev, m, _, reason in miss:
        add("missing", c, sev, n, pct, None, m, reason)
    if dups:
        add("duplicates", "*", "MED", dups, pround(dups / sc.rows * 100, 2), None, "remove_duplicates")
    for c, _, sug, conv, conv_pct in types:
        add("type_issues", c, "MED", conv, conv_pct, f"string -> {sug}", sug)
    for c, n, pct, lo, hi, sev, m, _, reason in outl:
        add("outliers", c, sev, n, pct, f"IQR [{lo}, {hi}]", m, reason)
    fmt = {}
    for c, f, n in fmts:
        fmt.setdefault(c, []).append((f, n))
    for c, items in fmt.items():
        add("inconsistent_formats", c, "LOW", sum(n for _, n in items), None, " | ".join(f"{k}:{n}" for k, n in items), "date_format")
    for c, lo, up, ti, mixed in cases:
        add("inconsistent_formats", c, "LOW", mixed, None, f"lower:{lo} upper:{up} title:{ti} mixed:{mixed}", "casing")
    typos = {}
    for r in typo_rows:  # at most 200 values a column by rule
        typos.setdefault(r["column"], {})[r["value"]] = r["match"]
    for c, mapping in typos.items():
        add("typo_candidates", c, "LOW", len(mapping), None, ", ".join(f"{a} -> {b}" for a, b in mapping.items()), mapping=mapping)
    out = spark.createDataFrame(rows, FINDINGS_SCHEMA)
    if suppress:
        sup = spark.createDataFrame([tuple(k) for k in suppress], "section string, column string")
        out = out.join(F.broadcast(sup), ["section", "column"], "left_anti")  # a user's ignore list
    return out


def typo_mapping(findings_df: DataFrame) -> DataFrame:
    """``(column, value, match)``: every replacement of the typo findings, one row per pair."""
    return findings_df.where(F.col("mapping").isNotNull()).select("column", F.explode("mapping").alias("value", "match"))


def column_status(t: Table, findings_df: DataFrame) -> DataFrame:
    """``(column, status)``: error when over 30% missing, warn on any finding, else ok."""
    per = (findings_df.where(F.col("column") != "*")
           .groupBy("column").agg(F.max(F.when((F.col("section") == "missing") & (F.col("pct") > MISSING_HIGH), 2)
                                        .otherwise(1)).alias("rank")))
    spark = t.df.sparkSession
    cols = spark.createDataFrame([(c, i) for i, c in enumerate(t.columns)], "column string, ord int")
    return (cols.join(per, "column", "left")
            .select("column", "ord",
                    F.when(F.col("rank") == 2, "error").when(F.col("rank") == 1, "warn").otherwise("ok")
                    .alias("status")))


def fix_plan(findings_df: DataFrame) -> DataFrame:
    """``(section, column, operation, method)``: the step that would fix each
    finding.  ``fix_steps`` makes steps of them; nothing is auto-applied."""
    kind = F.when(F.col("section") == "inconsistent_formats", F.concat_ws(":", "section", "method")).otherwise(F.col("section"))
    op = F.create_map(*[F.lit(x) for pair in FIX_OPERATIONS.items() for x in pair])[kind]
    method = F.when(F.col("section").isin("missing", "outliers", "type_issues"), F.col("method"))
    return findings_df.select("section", "column", op.alias("operation"), method.alias("method"))


def dominant_case(detail: str) -> str:
    """The case most values of a casing finding have already; ties go to the first of lower, upper, title."""
    counts = dict(part.split(":") for part in detail.split())
    return max(("lower", "upper", "title"), key=lambda k: int(counts[k]))


def fix_steps(findings_df: DataFrame) -> list:
    """The plan as recipe steps, in the findings' order; the caller picks and
    appends them to a ``Recipe``.  Typo fixes carry the full mapping, casing
    fixes the class that most values have."""
    from scrubjay.plans.recipe import Step
    steps = []
    for r in findings_df.collect():  # one row per finding
        kind = f"{r['section']}:{r['method']}" if r["section"] == "inconsistent_formats" else r["section"]
        params = {"missing": {"method": r["method"]}, "outliers": {"method": r["method"]}, "type_issues": {"target": r["method"]},
                  "typo_candidates": {"mapping": dict(r["mapping"] or {})}}.get(r["section"], {})
        if kind.endswith(":casing"):
            params = {"case": dominant_case(r["detail"])}
        steps.append(Step(FIX_OPERATIONS[kind], None if r["column"] == "*" else r["column"], params))
    return steps
