"""Moments, skewness and correlation from plain sums.

Spark's central-moment aggregates (``stddev``, ``skewness``, ``covar_samp``)
update several buffer fields with divisions per row; dozens of them in one
``agg`` also push the generated code past what whole-stage codegen and the
JIT handle well.  Here every statistic is a ``sum``/``count``/``min``/``max``
(one buffer field each, fully code-generated), evaluated in two passes:
first the mean, then sums of powers of ``x - mean`` (numerically stable).
Wide requests are split into several aggregates of bounded width
(``FIELD_BUDGET`` buffer fields); results are small dictionaries.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELD_BUDGET = 64


def agg_dict(df: DataFrame, items, budget: int = FIELD_BUDGET) -> dict:
    """Evaluate ``[(name, aggregate Column, fields), ...]`` in aggregates of
    at most ``budget`` buffer fields each; return ``{name: value}``."""
    out, batch, used = {}, [], 0

    def flush():
        if batch:
            row = df.agg(*[c.alias(n) for n, c in batch]).first()
            out.update(row.asDict())
            batch.clear()

    for name, expr, fields in items:
        if used + fields > budget and batch:
            flush()
            used = 0
        batch.append((name, expr))
        used += fields
    flush()
    return out


def moments(df: DataFrame, cols: dict, extra=(), extra_out: dict | None = None) -> dict:
    """``cols``: ``{key: double Column}``.  Returns ``{key: dict(n, mean, min,
    max, m2, m3)}`` with ``m2``/``m3`` the sums of squared/cubed deviations.

    ``extra`` aggregates (``(name, Column, fields)``) ride along in the first
    pass; their values land in ``extra_out``."""
    first = list(extra)
    for i, (k, v) in enumerate(cols.items()):
        first += [(f"n{i}", F.count(v), 1), (f"s{i}", F.sum(v), 1),
                  (f"lo{i}", F.min(v), 1), (f"hi{i}", F.max(v), 1)]
    a = agg_dict(df, first)
    if extra_out is not None:
        extra_out.update({name: a[name] for name, _, _ in extra})
    means = {k: (a[f"s{i}"] / a[f"n{i}"]) if a[f"n{i}"] else None for i, k in enumerate(cols)}
    powers = power_sums(df, cols, means)
    return {k: {"n": a[f"n{i}"], "mean": means[k], "min": a[f"lo{i}"], "max": a[f"hi{i}"], **powers[k]} for i, k in enumerate(cols)}


def power_sums(df: DataFrame, cols: dict, means: dict) -> dict:
    """``{key: {m2, m3}}``: sums of squared and cubed deviations from the given means (null without a mean)."""
    items = []
    for i, (k, v) in enumerate(cols.items()):
        if means[k] is not None:
            d = v - F.lit(means[k])
            items += [(f"m2_{i}", F.sum(d * d), 1), (f"m3_{i}", F.sum(d * d * d), 1)]
    b = agg_dict(df, items) if items else {}
    return {k: {"m2": b.get(f"m2_{i}"), "m3": b.get(f"m3_{i}")} for i, k in enumerate(cols)}


def skew_from(m: dict) -> float:
    """Bias-corrected sample skewness (G1) rounded to 2 decimals; 0 if undefined."""
    from scrubjay.functions.exprs import pround
    n, m2, m3 = m["n"], m["m2"], m["m3"]
    if not n or n < 3 or m2 is None or m2 <= 0 or m["min"] == m["max"]:
        return 0.0
    var = m2 / (n - 1)
    if not var > 0 or math.sqrt(var) == 0:
        return 0.0
    g1 = (m3 / n) / (m2 / n) ** 1.5
    g = g1 * math.sqrt(n * (n - 1)) / (n - 2)
    return pround(g, 2) if math.isfinite(g) else 0.0


def std_from(m: dict):
    n, m2 = m["n"], m["m2"]
    if not n or n < 2 or m2 is None:
        return None
    return math.sqrt(max(m2, 0.0) / (n - 1))


def correlations(df: DataFrame, cols: dict, null_free: set | None = None, means: dict | None = None) -> dict:
    """Pairwise-complete Pearson r for every pair of ``cols`` (``{key: double
    Column}``).  Returns ``{(a, b): r or None}`` for ``a <= b`` in key order.

    Sums are taken of deviations from each column's overall mean (a shift, so
    the pair formula stays exact); pairs of columns without nulls share the
    per-column sums, other pairs use sums masked to rows where both exist."""
    keys = list(cols)
    if means is None or null_free is None:
        first = []
        for i, k in enumerate(keys):
            first += [(f"n{i}", F.count(cols[k]), 1), (f"s{i}", F.sum(cols[k]), 1),
                      (f"lo{i}", F.min(cols[k]), 1), (f"hi{i}", F.max(cols[k]), 1)]
        first.append(("rows", F.count(F.lit(1)), 1))
        a = agg_dict(df, first)
        means = {k: (a[f"s{i}"] / a[f"n{i}"] if a[f"n{i}"] else 0.0) for i, k in enumerate(keys)}
        null_free = {k for i, k in enumerate(keys) if a[f"n{i}"] == a["rows"]}
        constant = {k for i, k in enumerate(keys) if a[f"lo{i}"] is not None and a[f"lo{i}"] == a[f"hi{i}"]}
    else:
        constant = set()
    dev = {k: cols[k] - F.lit(means[k] or 0.0) for k in keys}
    items = [("rows", F.count(F.lit(1)), 1)]
    for i, k in enumerate(keys):
        if k in null_free:
            items += [(f"d{i}", F.sum(dev[k]), 1), (f"dd{i}", F.sum(dev[k] * dev[k]), 1)]
    pairs = [(i, j) for i in range(len(keys)) for j in range(i, len(keys))]
    for i, j in pairs:
        a, b = keys[i], keys[j]
        if a in null_free and b in null_free:
            items.append((f"xy{i}_{j}", F.sum(dev[a] * dev[b]), 1))
        else:
            both = cols[a].isNotNull() & cols[b].isNotNull()
            x, y = F.when(both, dev[a]), F.when(both, dev[b])
            items += [(f"n{i}_{j}", F.count(x), 1), (f"x{i}_{j}", F.sum(x), 1), (f"y{i}_{j}", F.sum(y), 1),
                      (f"xy{i}_{j}", F.sum(x * y), 1), (f"xx{i}_{j}", F.sum(x * x), 1), (f"yy{i}_{j}", F.sum(y * y), 1)]
    s = agg_dict(df, items)
    out = {}
    for i, j in pairs:
        a, b = keys[i], keys[j]
        if a in null_free and b in null_free:
            n = s["rows"]
            sx, sy, sxx, syy = s[f"d{i}"], s[f"d{j}"], s[f"dd{i}"], s[f"dd{j}"]
        else:
            n = s[f"n{i}_{j}"]
            sx, sy, sxx, syy = s[f"x{i}_{j}"], s[f"y{i}_{j}"], s[f"xx{i}_{j}"], s[f"yy{i}_{j}"]
        sxy = s[f"xy{i}_{j}"]
        if not n or n < 2 or sxy is None or a in constant or b in constant:
            out[(a, b)] = None
            continue
        cxy = sxy - sx * sy / n
        cxx = sxx - sx * sx / n
        cyy = syy - sy * sy / n
        den = math.sqrt(cxx * cyy) if cxx > 0 and cyy > 0 else 0.0
        out[(a, b)] = (cxy / den) if den > 0 else None
    return out
