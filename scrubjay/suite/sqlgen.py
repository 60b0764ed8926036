"""Oracle SQL generators for per-column profiles and quality findings.

Each returns a DuckDB SELECT with the same columns as the library function
it checks, expanded over an explicit column list (UNION ALL per column).
"""

from __future__ import annotations

from scrubjay.functions.dates import DATE_TEXT_PATTERNS, PARSE_FORMATS
from scrubjay.suite import sqlfrag as S


def union(parts):
    return "\nUNION ALL\n".join(parts)


def missing(tbl, num_cols, other_cols):
    parts = []
    for c in num_cols + other_cols:
        n = f"(count(*) - count({c}))"
        pct = f"round({n} / count(*) * 100, 2)"
        if c in num_cols:
            sk = skew_expr(c)
            method = f"CASE WHEN count({c}) = 0 THEN 'zero' WHEN abs({sk}) <= 0.5 THEN 'mean' ELSE 'median' END"
            skc = sk
        else:
            method, skc = "'mode'", "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS column, {n} AS count, {pct} AS pct, "
                     f"CASE WHEN {pct} > 30 THEN 'HIGH' WHEN {pct} > 10 THEN 'MED' ELSE 'LOW' END AS severity, "
                     f"{method} AS method, {skc} AS skew FROM {tbl}")
    return f"SELECT * FROM ({union(parts)}) WHERE count > 0"


def skew_expr(c):
    return (f"(CASE WHEN count({c}) < 3 OR stddev_samp({c}) = 0 OR isnan(skewness({c})) THEN 0.0 "
            f"ELSE round(skewness({c}), 2) END)")


def outliers(tbl, num_cols):
    parts = []
    for c in num_cols:
        parts.append(
            f"SELECT '{c}' AS column, count({c}) AS nn, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, "
            f"count(*) AS rows, {skew_expr(c)} AS skew FROM {tbl}")
    fences = f"SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM ({union(parts)}) WHERE nn >= 4"
    counts = union([f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} < f.lo OR {c} > f.hi) AS count "
                    f"FROM {tbl}, (SELECT lo, hi FROM fences WHERE column = '{c}') f" for c in num_cols])
    return (f"WITH fences AS ({fences}), counts AS ({counts}), "
            f"j AS (SELECT f.column, c.count, round(c.count / f.rows * 100, 2) AS pct, round(f.lo, 4) AS lower_bound, "
            f"round(f.hi, 4) AS upper_bound, f.skew FROM fences f JOIN counts c ON f.column = c.column WHERE c.count > 0) "
            f"SELECT column, count, pct, lower_bound, upper_bound, "
            f"CASE WHEN pct > 5 THEN 'HIGH' ELSE 'MED' END AS severity, "
            f"CASE WHEN pct > 5 THEN 'cap' WHEN abs(skew) > 1 THEN 'cap' ELSE 'remove' END AS method, skew FROM j")


def type_issues(tbl, str_cols):
    parts = []
    for c in str_cols:
        dts = ", ".join(f"count(try_strptime({c}, '{p}'))" for _, p in PARSE_FORMATS)
        parts.append(f"SELECT '{c}' AS column, count({c}) AS n, count({S.num(c)}) AS num_ok, "
                     f"greatest({dts}) AS dt_ok FROM {tbl}")
    return (f"SELECT column, 'string' AS current, "
            f"CASE WHEN num_ok / n >= 0.7 THEN 'numeric' ELSE 'datetime' END AS suggested, "
            f"CASE WHEN num_ok / n >= 0.7 THEN num_ok ELSE dt_ok END AS convertible, "
            f"round(CASE WHEN num_ok / n >= 0.7 THEN num_ok ELSE dt_ok END / n * 100, 2) AS convertible_pct "
            f"FROM ({union(parts)}) WHERE n > 0 AND (num_ok / n >= 0.7 OR dt_ok / n >= 0.7)")


def pattern_counts(tbl, str_cols):
    parts = []
    for c in str_cols:
        for name, pat in DATE_TEXT_PATTERNS:
            parts.append(f"SELECT '{c}' AS column, '{name}' AS format, "
                         f"count(*) FILTER (WHERE regexp_matches({c}, '{pat}')) AS count FROM {tbl}")
    return union(parts)


def date_formats(tbl, str_cols):
    return (f"WITH p AS ({pattern_counts(tbl, str_cols)}) SELECT column, format, count FROM p "
            f"WHERE count > 0 AND column IN (SELECT column FROM p WHERE count > 0 GROUP BY column HAVING count(*) > 1)")


def casing(tbl, str_cols):
    parts = []
    for c in str_cols:
        cs = S.cased(c)
        parts.append(f"SELECT '{c}' AS column, count({c}) AS n, "
                     f"count(*) FILTER (WHERE {cs} AND lower({c}) = {c}) AS lower, "
                     f"count(*) FILTER (WHERE {cs} AND upper({c}) = {c}) AS upper, "
                     f"count(*) FILTER (WHERE {cs} AND {S.title(c)} = {c}) AS title FROM {tbl}")
    return (f"WITH p AS ({pattern_counts(tbl, str_cols)}), "
            f"df AS (SELECT column FROM p WHERE count > 0 GROUP BY column HAVING count(*) > 1), "
            f"k AS ({union(parts)}) "
            f"SELECT column, lower, upper, title, n - lower - upper - title AS mixed FROM k "
            f"WHERE column NOT IN (SELECT column FROM df) AND n > 10 AND greatest(lower, upper, title) < n * 0.8")


def typos_lev(tbl, str_cols):
    """Typo candidates scored by ``1 - levenshtein / max(length)``."""
    parts = []
    for c in str_cols:
        parts.append(f"SELECT '{c}' AS column, {c} AS value, count(*) AS n FROM {tbl} WHERE {c} IS NOT NULL GROUP BY {c}")
    return (f"WITH vc0 AS ({union(parts)}), "
            f"vc AS (SELECT * FROM vc0 WHERE column IN (SELECT column FROM vc0 GROUP BY column "
            f"HAVING count(*) BETWEEN 3 AND 200)), "
            f"canon AS (SELECT column, value AS match, n AS match_count FROM vc "
            f"QUALIFY row_number() OVER (PARTITION BY column ORDER BY n DESC, value) <= 30), "
            f"pairs AS (SELECT vc.column, vc.value, vc.n AS value_count, canon.match, canon.match_count, "
            f"1 - levenshtein(vc.value, canon.match) / greatest(length(vc.value), length(canon.match)) AS score "
            f"FROM vc JOIN canon ON vc.column = canon.column AND canon.match <> vc.value), "
            f"best AS (SELECT * FROM pairs WHERE score >= 0.85 "
            f"QUALIFY row_number() OVER (PARTITION BY column, value ORDER BY score DESC, match DESC) = 1) "
            f"SELECT column, value, match, round(score, 4) AS score, value_count, match_count FROM best "
            f"WHERE value_count < match_count")


def duplicates(tbl, cols):
    return (f"SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(cols)} FROM {tbl})) AS BIGINT) "
            f"AS duplicates FROM {tbl}")


FINDINGS_SELECT = (
    "SELECT 'missing' AS section, column, severity, count FROM mi "
    "UNION ALL SELECT 'duplicates', '*', 'MED', duplicates FROM du WHERE duplicates > 0 "
    "UNION ALL SELECT 'type_issues', column, 'MED', convertible FROM ty "
    "UNION ALL SELECT 'outliers', column, severity, count FROM ou "
    "UNION ALL SELECT 'inconsistent_formats', column, 'LOW', sum(count) FROM fo GROUP BY column "
    "UNION ALL SELECT 'inconsistent_formats', column, 'LOW', mixed FROM ca "
    "UNION ALL SELECT 'typo_candidates', column, 'LOW', count(*) FROM tp GROUP BY column")


def findings_ctes(tbl, num_cols, other_cols, str_cols, all_cols):
    """CTEs mi, du, ty, ou, fo, ca, tp: one per finding section."""
    return (f"mi AS ({missing(tbl, num_cols, other_cols)}), "
            f"du AS ({duplicates(tbl, all_cols)}), "
            f"ty AS ({type_issues(tbl, str_cols)}), "
            f"ou AS ({outliers(tbl, num_cols)}), "
            f"fo AS ({date_formats(tbl, str_cols)}), "
            f"ca AS ({casing(tbl, str_cols)}), "
            f"tp AS ({typos_lev(tbl, str_cols)})")


def findings(tbl, num_cols, other_cols, str_cols, all_cols):
    """(section, column, severity, count) for every finding section."""
    return f"WITH {findings_ctes(tbl, num_cols, other_cols, str_cols, all_cols)} {FINDINGS_SELECT}"


def histogram(tbl, c, bins_expr, trim=False):
    """Equal-width bins over [min, max] (+-0.5 when constant); ``bins_expr``
    uses n (non-null count) and d (distinct count)."""
    base = (f"WITH s AS (SELECT count({c}) AS n, count(DISTINCT {c}) AS d, min({c}) AS lo0, max({c}) AS hi0, "
            f"avg({c}) AS m, quantile_cont({c}, 0.5) AS med FROM {tbl}), "
            f"k AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, "
            f"CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi, CAST({bins_expr} AS BIGINT) AS nb, m, med FROM s), "
            f"c AS (SELECT least(CAST(floor(({c} - lo) * (nb / (hi - lo))) AS BIGINT), nb - 1) AS bin, count(*) AS cnt "
            f"FROM {tbl}, k WHERE {c} IS NOT NULL GROUP BY 1), "
            f"r AS (SELECT unnest(range(nb)) AS bin FROM k), "
            f"h AS (SELECT '{c}' AS column, CAST(r.bin AS INTEGER) AS bin, lo + r.bin * ((hi - lo) / nb) AS bin_lo, "
            f"lo + (r.bin + 1) * ((hi - lo) / nb) AS bin_hi, coalesce(c.cnt, 0) AS count, "
            f"round(m, 4) AS mean, round(med, 4) AS median FROM r CROSS JOIN k LEFT JOIN c ON c.bin = r.bin) ")
    if not trim:
        return base + "SELECT * FROM h"
    return (base + ", e AS (SELECT min(bin) FILTER (WHERE count > 0) AS f, max(bin) FILTER (WHERE count > 0) AS l FROM h) "
            "SELECT h.* FROM h, e WHERE e.f IS NULL OR (h.bin >= e.f AND h.bin <= e.l)")
