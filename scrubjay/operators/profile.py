"""Column profiling (P1-P8), as long ``(column, ...)`` outputs.

Per-column numbers come from bounded-width aggregates over all columns at
once (plain counts and sums, so they stay code-generated); only these small
aggregates, quantiles and histogram bounds travel through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubjay.functions.exprs import (col, is_numeric_type, is_string_type, pround,
                                      round_half_away, type_family)
from scrubjay.functions.moments import agg_dict, moments, skew_from, std_from
from scrubjay.functions.quantiles import quantiles, summaries, value_stats
from scrubjay.operators.patches import small_side
from scrubjay.plans.table import RID, Table
from scrubjay.session import staged


#: Bytes up to which a text is compared as it is; below the 32 of its digest.
DIGEST_OVER = 31


def typed_cells(df: DataFrame, columns, text: bool = False) -> DataFrame:
    """Every non-null cell as ``(k, s, l, d)``: the column's place and the value
    in a typed slot (integers, booleans, dates and instants as a long; floats
    as a double with -0.0 folded into 0.0; text, wall-clock timestamps and
    decimals as exact text), so equal values meet and unequal ones never do.
    ``text`` adds ``t``, the value as text that casts back.  The unpivot is an
    explode of an array and a filter, which stay in generated code."""
    schema = {f.name: f.dataType for f in df.schema.fields}
    entries = []
    for i, c in enumerate(columns):
        dt, v = schema[c], col(c)
        s = lg = db = None
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            lg = v.cast("long")
        elif isinstance(dt, T.BooleanType):
            lg = v.cast("int").cast("long")
        elif isinstance(dt, T.DateType):
            lg = F.unix_date(v).cast("long")
        elif isinstance(dt, T.TimestampType):
            lg = F.unix_micros(v)
        elif isinstance(dt, (T.FloatType, T.DoubleType)):
            db = F.when(v == 0, F.lit(0.0)).otherwise(v.cast("double"))
        elif isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
            s = v
        elif isinstance(dt, (T.ArrayType, T.StructType, T.MapType)):
            s = F.to_json(v)
        else:  # timestamp_ntz, decimal, binary: exact text forms
            s = F.hex(v) if isinstance(dt, T.BinaryType) else v.cast("string")
        slots = [F.lit(i).alias("k"),
                 (s if s is not None else F.lit(None).cast("string")).alias("s"),
                 (lg if lg is not None else F.lit(None).cast("long")).alias("l"),
                 (db if db is not None else F.lit(None).cast("double")).alias("d")]
        if text:
            slots.append((F.to_json(v) if isinstance(dt, (T.ArrayType, T.StructType, T.MapType)) else v.cast("string")).alias("t"))
        entries.append(F.when(v.isNotNull(), F.struct(*slots)))
    return df.select(F.explode(F.array(*entries)).alias("e")).where("e IS NOT NULL").select("e.*")


def distinct_counts(df: DataFrame, columns) -> dict:
    """Distinct counts of many columns in one pass: typed cells, a hash
    aggregate that removes repeats (map-side first, so a hot value costs
    nothing), then one that counts per column.

    Text over ``DIGEST_OVER`` bytes takes part by its SHA-256, whose 32 bytes no
    shorter text equals, so what is shuffled is bounded by distinct values, not
    by their lengths. Counts are exact unless two texts share a SHA-256."""
    columns = list(columns)
    if not columns:
        return {}
    s = F.encode("s", "utf-8")
    short = F.when(F.octet_length("s") > DIGEST_OVER, F.unhex(F.sha2(s, 256))).otherwise(s)
    counted = typed_cells(df, columns).withColumn("s", short).distinct().groupBy("k").agg(F.count("*").alias("n")).collect()
    out = {c: 0 for c in columns}
    out.update({columns[r["k"]]: r["n"] for r in counted})
    return out


def capped_distinct(df: DataFrame, columns, cap: int) -> dict:
    """Exact distinct counts where they can be at most ``cap``; ``cap + 1`` for
    the rest.  A HyperLogLog estimate first rules out columns well above the
    cap, so no exact distinct shuffles a high-cardinality column.  Its relative
    standard error is 5%: an estimate of over twice the cap for a column at the
    cap would be off by 20 standard errors."""
    columns = list(columns)
    if not columns:
        return {}
    approx = df.agg(*[F.approx_count_distinct(col(c)).alias(f"a{i}") for i, c in enumerate(columns)]).first()
    near = [c for i, c in enumerate(columns) if approx[f"a{i}"] <= 2 * cap]
    out = {c: cap + 1 for c in columns}
    if near:
        out.update({c: min(n, cap + 1) for c, n in distinct_counts(df, near).items()})
    return out


def numeric_columns(t: Table) -> list[str]:
    return [c for c in t.columns if is_numeric_type(t.dtype(c))]


def text_columns(t: Table) -> list[str]:
    return [c for c in t.columns if is_string_type(t.dtype(c))]


def categorical_columns(t: Table) -> list[str]:
    """Non-numeric columns (strings, booleans, dates): value-count profiles."""
    return [c for c in t.columns if not is_numeric_type(t.dtype(c))]


# -- P1 / P2 ------------------------------------------------------------------------------
def column_stats(t: Table, columns=None, approx_distinct: bool = False, distinct: bool = True) -> DataFrame:
    """``(column, dtype, null_count, null_pct, unique_count, distinct_pct)``.

    Null counts are plain counts in one aggregate; exact distinct counts of
    all columns take one more pass (``distinct_counts``); ``approx_distinct``
    uses HyperLogLog and ``distinct=False`` skips them."""
    columns = list(columns or t.columns)
    spark = t.df.sparkSession
    fams = {c: type_family(t.dtype(c)) for c in columns}
    nn = agg_dict(t.df, [("__rows", F.count(F.lit(1)), 1)] +
                  [(f"nn{i}", F.count(col(c)), 1) for i, c in enumerate(columns)])
    d = {}
    if distinct and approx_distinct:
        row = t.df.agg(*[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
        d = {c: row[f"d{i}"] for i, c in enumerate(columns)}
    elif distinct:
        d = distinct_counts(t.df, columns)
    rows = nn["__rows"]
    out = []
    for i, c in enumerate(columns):
        nulls = rows - nn[f"nn{i}"]
        u = d.get(c)
        out.append((c, fams[c], nulls, pround(nulls / rows * 100, 2) if rows else 0.0,
                    u, (pround(u / rows * 100, 0) if rows else 0.0) if u is not None else None))
    return spark.createDataFrame(out, "column string, dtype string, null_count long, null_pct double, "
                                      "unique_count long, distinct_pct double")


# -- P3 ---------------------------------------------------------------------------------------
def numeric_summary(t: Table, columns=None, method: str = "exact") -> DataFrame:
    """``(column, count, mean, std, min, max, q25, median, q75)`` to 4 decimals;
    columns with no values are omitted."""
    columns = list(columns or numeric_columns(t))
    spark = t.df.sparkSession
    schema = "column string, count long, mean double, std double, min double, max double, " \
             "q25 double, median double, q75 double"
    if not columns:
        return spark.createDataFrame([], schema)
    found, _ = summaries(t.df, [(c, col(c), None) for c in columns], QUARTILES, method)
    return spark.createDataFrame([(c, found[c][0].n, *_numeric(found[c])) for c in columns if found[c][0].n], schema)


QUARTILES = [0.25, 0.5, 0.75]


def _numeric(found: tuple) -> tuple:
    """Mean, standard deviation, min, max and quartiles to 4 decimals; nulls where there is no value."""
    st, squares, q = found
    if not st.n:
        return (None,) * 7
    return (_r4(st.mean), _r4(std_from({"n": st.n, "m2": squares})), _r4(st.lo), _r4(st.hi), *map(_r4, q))


def _r4(x):
    return pround(x, 4)


def column_profile(t: Table, method: str = "exact", approx_distinct: bool = False) -> DataFrame:
    """One row per column: P1 + P2 for every column and the P3 numeric
    summary for numeric ones (null elsewhere) - the per-column stats panel.
    Null counts ride in the first pass, squared deviations in that of the quantiles.
    ``approx_distinct`` replaces the exact distinct counts, which shuffle every
    distinct cell, by HyperLogLog sketches."""
    rows, _, _ = _profiled(t, t.columns, method, approx_distinct)
    return t.df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


PROFILE_SCHEMA = ("column string, dtype string, null_count long, null_pct double, unique_count long, "
                  "distinct_pct double, mean double, std double, min double, max double, q25 double, "
                  "median double, q75 double")


def _profiled(t: Table, cols, method: str, approx_distinct: bool) -> tuple:
    """(rows of ``PROFILE_SCHEMA``, summaries of the numeric columns, distinct counts)."""
    from concurrent.futures import ThreadPoolExecutor
    nums = [c for c in cols if is_numeric_type(t.dtype(c))]

    def numeric_chain():
        extra = {"__rows": F.lit(1)} | {f"__nn{i}": col(c) for i, c in enumerate(cols)}
        return summaries(t.df, [(c, col(c), None) for c in nums], QUARTILES, method, extra)

    def distinct_chain():
        if approx_distinct:
            row = t.df.agg(*[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
            return {c: row[f"d{i}"] for i, c in enumerate(cols)}
        return distinct_counts(t.df, cols)

    with ThreadPoolExecutor(max_workers=2) as pool:  # independent jobs, submitted together
        f_num, f_d = pool.submit(numeric_chain), pool.submit(distinct_chain)
        (found, counts), d = f_num.result(), f_d.result()
    rows_n = counts["__rows"]
    rows = []
    for i, c in enumerate(cols):
        nulls = rows_n - counts[f"__nn{i}"]
        base = (c, type_family(t.dtype(c)), nulls, pround(nulls / rows_n * 100, 2) if rows_n else 0.0,
                d[c], pround(d[c] / rows_n * 100, 0) if rows_n else 0.0)
        rows.append(base + (_numeric(found[c]) if c in found else (None,) * 7))
    return rows, found, d


def column_panel(t: Table, columns=None, k: int = 5, max_bins: int = 24, method: str = "exact", approx_distinct: bool = False) -> DataFrame:
    """The whole panel of every column in one call: ``column_profile`` plus
    ``bins`` (P5, numeric columns; null where a column has no value) and ``top``
    (P4, the k most frequent values of the others).

    Bounds and bin counts come from the profile's own passes, so the histograms
    cost one more pass of bin counts and the top values one grouped count.
    ``approx_distinct`` sketches distinct counts; only columns that may be under
    ``max_bins`` are then counted exactly, for their bins."""
    cols = list(columns or t.columns)
    rows, found, d = _profiled(t, cols, method, approx_distinct)
    v = {c: col(c).cast("double") for c, (st, _, _) in found.items() if st.n}
    if approx_distinct and v:
        vals = t.df.select(*[x.alias(f"__sj_v{i}") for i, x in enumerate(v.values())])
        d = dict(d, **dict(zip(v, capped_distinct(vals, vals.columns, max_bins).values(), strict=True)))
    edges, counts = _binned(t.df, v, {c: (found[c][0].lo, found[c][0].hi) for c in v}, {c: max(1, min(max_bins, d[c])) for c in v})
    bins = {c: [(b, lo + b * width, lo + (b + 1) * width, counts.get((c, b), 0)) for b in range(n)] for c, (lo, width, n) in edges.items()}
    texts = [c for c in cols if not is_numeric_type(t.dtype(c))]
    top: dict = {}
    if texts:
        for r in top_values(t, texts, k).orderBy("column", "rank").collect():  # k rows a column
            top.setdefault(r["column"], []).append((r["value"], r["count"], r["rank"]))
    return t.df.sparkSession.createDataFrame(
        [(*r, bins.get(r[0]), top.get(r[0], []) if r[0] in texts else None) for r in rows],
        PROFILE_SCHEMA + ", bins array<struct<bin: int, bin_lo: double, bin_hi: double, count: bigint>>"
                         ", top array<struct<value: string, count: bigint, rank: int>>")


# -- P4 ------------------------------------------------------------------------------------------
def top_values(t: Table, columns=None, k: int = 5) -> DataFrame:
    """``(column, value, count, rank)``: the k most frequent values per column,
    ties by value, for all columns in one pass: unpivot, count, ranked window."""
    columns = list(columns or categorical_columns(t))
    spark = t.df.sparkSession
    if not columns:
        return spark.createDataFrame([], TOP_SCHEMA)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]))
    counts = (t.df.select(cells.alias("e")).select("e.column", "e.value").where(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count("*").alias("count")))
    return _ranked(counts, k)


def top_values_by_hash(t: Table, columns=None, k: int = 5, hash_of=F.xxhash64) -> DataFrame:
    """``top_values`` for columns of long or near-unique values, whose texts it does not shuffle.

    Counts by 64-bit hash come first, and the k-th largest of a column is its
    bound: a value is counted by its hash at least, so no winner's hash counts
    less.  Only values of hashes that reach the bound are counted as text.
    Where the bound is 1, under k hashes are repeated at all; all other rows
    are single values, and a top-k of rows finds the smallest of them.  A bound
    raised by values that share a hash is lowered to the counts found, and the
    values are counted again: the result is exact."""
    columns = list(columns or categorical_columns(t))
    spark = t.df.sparkSession
    if not columns or k < 1:
        return spark.createDataFrame([], TOP_SCHEMA)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]))
    rows = t.df.select(cells.alias("e")).select("e.column", "e.value").where(F.col("value").isNotNull()).withColumn("h", hash_of("value"))
    hashed = staged(rows.groupBy("column", "h").agg(F.count("*").alias("n")), "hashes")
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "h"))
    best = hashed.withColumn("r", place).where(F.col("r") <= k).collect()  # k rows a column
    leaders: dict = {}
    for r in best:
        leaders.setdefault(r["column"], []).append((r["n"], r["h"]))
    bound = {c: min(n for n, _ in found) if len(found) == k else 1 for c, found in leaders.items()}
    parts = []
    for c in [c for c in columns if bound.get(c) == 1]:  # under k repeated hashes, or all values are winners
        repeated = [h for n, h in leaders[c] if n > 1]
        mine = rows.where(F.col("column") == c)
        single = mine.where(~F.col("h").isin(repeated)).select("column", "value", F.lit(1).cast("long").alias("count"))
        parts.append(single.orderBy("value").limit(k))
        parts.append(mine.where(F.col("h").isin(repeated)).groupBy("column", "value").agg(F.count("*").alias("count")))
    todo = {c: n for c, n in bound.items() if n > 1}
    while todo:
        reach = F.coalesce(*[F.when((F.col("column") == c) & (F.col("n") >= n), True) for c, n in todo.items()], F.lit(False))
        wanted = small_side(hashed.where(reach).select("column", "h"))
        counted = staged(rows.join(wanted, ["column", "h"], "left_semi").groupBy("column", "value").agg(F.count("*").alias("count")), "candidates")
        kth = {r["column"]: r["count"] for r in _ranked(counted, k).where(F.col("rank") == k).collect()}
        short = {c: kth.get(c, 1) for c, n in todo.items() if kth.get(c, 1) < n}
        parts.append(counted.where(~F.col("column").isin(list(short))))
        todo = short
    return _ranked(reduce(DataFrame.unionByName, parts), k) if parts else spark.createDataFrame([], TOP_SCHEMA)


TOP_SCHEMA = "column string, value string, count long, rank int"


def _ranked(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent values per column, ties by value; the limit is applied in every task before the column's values meet."""
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# -- P5 / V1 ---------------------------------------------------------------------------------------
HISTOGRAM_SCHEMA = "column string, bin int, bin_lo double, bin_hi double, count long, mean double, median double"


def histogram(t: Table, column: str, max_bins: int = 24, bins: int | None = None,
              rule: str = "distinct", method: str = "exact") -> DataFrame:
    """The histogram of one column (see ``histograms``)."""
    return histograms(t, [column], max_bins, bins, rule, method)


def histograms(t: Table, columns=None, max_bins: int = 24, bins: int | None = None,
               rule: str = "distinct", method: str = "exact") -> DataFrame:
    """Equal-width histograms of numeric columns with the last bin closed, plus
    mean/median markers; all columns share every pass.

    ``rule='distinct'``: ``max(1, min(max_bins, nunique))`` bins (profile);
    ``rule='chart'``: ``min(50, max(10, n // 20))`` bins (histogram chart).
    A constant column spans ``value +- 0.5``; one without values is left out.
    Output ``(column, bin, bin_lo, bin_hi, count, mean, median)``."""
    columns = list(columns or numeric_columns(t))
    spark = t.df.sparkSession
    v = {c: col(c).cast("double") for c in columns}
    st = agg_dict(t.df, [(f"{k}{i}", f(v[c]), 1) for i, c in enumerate(columns)
                         for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max), ("mean", F.avg))]) if columns else {}
    stats = {c: (st[f"n{i}"], st[f"lo{i}"], st[f"hi{i}"]) for i, c in enumerate(columns) if st[f"n{i}"]}
    if not stats:
        return spark.createDataFrame([], HISTOGRAM_SCHEMA)
    medians = quantiles(t.df, [(c, v[c], None) for c in stats], [0.5], method=method, stats=stats)
    if bins is None and rule == "distinct":
        vals = t.df.select(*[v[c].alias(f"__sj_v{i}") for i, c in enumerate(stats)])
        distinct = capped_distinct(vals, vals.columns, max_bins)
        n_bins = {c: max(1, min(max_bins, distinct[f"__sj_v{i}"])) for i, c in enumerate(stats)}
    else:
        n_bins = {c: bins or min(50, max(10, n // 20)) for c, (n, _, _) in stats.items()}
    edges, found = _binned(t.df, v, {c: (lo, hi) for c, (_, lo, hi) in stats.items()}, n_bins)
    mean = {c: st[f"mean{i}"] for i, c in enumerate(columns)}
    rows = [(c, b, lo + b * width, lo + (b + 1) * width, found.get((c, b), 0), _r4(mean[c]), _r4(medians[c][0]))
            for c, (lo, width, n) in edges.items() for b in range(n)]
    return spark.createDataFrame(rows, HISTOGRAM_SCHEMA)


def _binned(df: DataFrame, v: dict, bounds: dict, n_bins: dict) -> tuple:
    """({column: (lowest edge, width, bins)}, {(column, bin): count}) of equal bins
    between each column's bounds, of all columns in one pass."""
    edges, cells = {}, []
    for c, (lo, hi) in bounds.items():
        lo, hi = (float(lo) - 0.5, float(hi) + 0.5) if lo == hi else (float(lo), float(hi))
        edges[c] = (lo, (hi - lo) / n_bins[c], n_bins[c])
        b = F.when(v[c].isNotNull(),  # ``least`` passes over nulls
                   F.least(F.floor((v[c] - F.lit(lo)) * F.lit(n_bins[c] / (hi - lo))), F.lit(n_bins[c] - 1))).cast("int")
        cells.append(F.struct(F.lit(c).alias("column"), b.alias("bin")))
    if not cells:
        return {}, {}
    counted = (df.select(F.explode(F.array(*cells)).alias("e")).select("e.column", "e.bin").where(F.col("bin").isNotNull())
               .groupBy("column", "bin").count().collect())  # at most the bins of each column
    return edges, {(r["column"], r["bin"]): r["count"] for r in counted}


def trim_bins(hist: DataFrame) -> DataFrame:
    """Drop empty bins before the first and after the last non-empty bin (per column)."""
    w = Window.partitionBy("column")  # a histogram has <= 50 rows per column
    nonempty = F.when(F.col("count") > 0, F.col("bin"))
    return (hist.withColumn("__first", F.min(nonempty).over(w))
                .withColumn("__last", F.max(nonempty).over(w))
                .where(F.col("__first").isNull() |
                       ((F.col("bin") >= F.col("__first")) & (F.col("bin") <= F.col("__last"))))
                .drop("__first", "__last"))


# -- P6 ----------------------------------------------------------------------------------------------
BOX_SCHEMA = ("column string, min double, q1 double, median double, q3 double, max double, "
              "whisk_lo double, whisk_hi double, n_outliers long")


def _boxes(t: Table, columns, method: str) -> dict:
    """``{column: (n, min, q1, median, q3, max, whisker low, high, outliers)}``, all columns in shared passes."""
    v = {c: col(c).cast("double") for c in columns}
    stats, _ = value_stats(t.df, [(c, v[c], None) for c in columns], QUARTILES)
    stats = {c: s for c, s in stats.items() if s.n}
    if not stats:
        return {}
    qs = quantiles(t.df, [(c, v[c], None) for c in stats], QUARTILES, method=method, stats=stats)
    fences = {c: (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, _, q3) in qs.items()}
    items = []
    for i, (c, (lo, hi)) in enumerate(fences.items()):
        inside = (v[c] >= F.lit(lo)) & (v[c] <= F.lit(hi))
        items += [(f"wl{i}", F.min(F.when(inside, v[c])), 1), (f"wh{i}", F.max(F.when(inside, v[c])), 1),
                  (f"no{i}", F.count(F.when((v[c] < F.lit(lo)) | (v[c] > F.lit(hi)), 1)), 1)]
    w = agg_dict(t.df, items)
    out = {}
    for i, c in enumerate(fences):
        q1, med, q3 = qs[c]
        wl, wh = w[f"wl{i}"], w[f"wh{i}"]
        out[c] = (stats[c].n, stats[c].lo, q1, med, q3, stats[c].hi, q1 if wl is None else wl, q3 if wh is None else wh, w[f"no{i}"])
    return out


def box_summaries(t: Table, columns=None, method: str = "exact") -> DataFrame:
    """Five-number summaries with IQR whiskers and outlier counts, one row per
    numeric column with values; every pass is shared by all columns."""
    rows = [(c, *map(_r4, b[1:8]), b[8]) for c, b in _boxes(t, list(columns or numeric_columns(t)), method).items()]
    return t.df.sparkSession.createDataFrame(rows, BOX_SCHEMA)


def box_summary(t: Table, column: str, max_points: int = 40, method: str = "exact"):
    """One column's box and a deterministic sample of its outlier points.
    Returns ``(summary DataFrame, points DataFrame)``."""
    v = col(column).cast("double")
    box = _boxes(t, [column], method).get(column)
    summary = t.df.sparkSession.createDataFrame([(column, *map(_r4, box[1:8]), box[8])] if box else [], BOX_SCHEMA)
    if not box:
        return summary, t.df.sparkSession.createDataFrame([], "column string, _rid long, value double")
    _, _, q1, _, q3, _, _, _, _ = box
    outside = (v < F.lit(q1 - 1.5 * (q3 - q1))) | (v > F.lit(q3 + 1.5 * (q3 - q1)))
    points = (t.df.where(outside).select(F.lit(column).alias("column"), F.col(RID), round_half_away(v, 4).alias("value"))
              .orderBy(F.md5(F.col(RID).cast("string")), F.col(RID)).limit(max_points))
    return summary, points


# -- P7 ------------------------------------------------------------------------------------------------
def skew(t: Table, columns=None) -> DataFrame:
    """``(column, skew)``: corrected sample skewness, 2 decimals, 0 if undefined."""
    columns = list(columns or numeric_columns(t))
    spark = t.df.sparkSession
    mom = moments(t.df, {c: col(c).cast("double") for c in columns}) if columns else {}
    return spark.createDataFrame([(c, skew_from(mom[c])) for c in columns], "column string, skew double")


# -- P8 ------------------------------------------------------------------------------------------------
def row_hash(t: Table):
    """A struct of two 64-bit hashes of the whole row, nulls told apart by place."""
    cells = [c for name in t.columns for c in (col(name).isNull(), _hashable(col(name), t.dtype(name)))]
    return F.struct(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit(7), *reversed(cells)).alias("b"))


def _hashable(c, dt):
    """Equal values hash alike: -0.0 as 0.0, maps as text."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, F.lit(0.0).cast(dt)).otherwise(c)
    return F.to_json(c) if isinstance(dt, T.MapType) else c


#: Shared hashes (16 bytes each) that are broadcast as they are.
BROADCAST_HASHES = 1_000_000
#: 64-bit words of the Bloom filter that is broadcast beyond (16 bytes each).
BLOOM_WORDS = 1 << 20


def _keyed(t: Table, hashed) -> DataFrame:
    return t.df.withColumn("__sj_h", hashed(t)).select("*", F.col("__sj_h.a").alias("__sj_a"), F.col("__sj_h.b").alias("__sj_b")).drop("__sj_h")


class _Repeats:
    """Hashes that several rows have, staged once: (__sj_a, __sj_b, __sj_first, __sj_n), and those of unequal rows."""

    def __init__(self, t: Table, hashed):
        self.t, self.keyed = t, _keyed(t, hashed)
        counted = self.keyed.groupBy("__sj_a", "__sj_b").agg(F.min(RID).alias("__sj_first"), F.count("*").alias("__sj_n")).where("__sj_n > 1")
        self.shared = staged(counted, "shared")
        self.hashes, self.rows = self.shared.agg(F.count("*"), F.coalesce(F.sum("__sj_n"), F.lit(0))).first()
        self.mixed = None
        if self.hashes:
            # full rows are compared where a hash is shared: one distinct row a hash, but for a collision
            kinds = self.alike().select("__sj_a", "__sj_b", *[col(c) for c in t.columns]).distinct().groupBy("__sj_a", "__sj_b").count()
            mixed = kinds.where("count > 1").select("__sj_a", "__sj_b")
            self.mixed = mixed if mixed.take(1) else None

    def alike(self) -> DataFrame:
        return candidates(self.keyed, self.shared.select("__sj_a", "__sj_b"), self.hashes)

    def firsts(self) -> DataFrame:
        first = self.shared.select("__sj_a", "__sj_b", "__sj_first")
        return F.broadcast(first) if self.hashes <= BROADCAST_HASHES else first

    def unequal(self) -> DataFrame:
        """Rows whose hash stands for several distinct rows."""
        return self.alike().join(F.broadcast(self.mixed), ["__sj_a", "__sj_b"], "left_semi")  # collisions of 128 bits


def bloom_filter(hashes: DataFrame, words: int) -> DataFrame:
    """(__sj_w, __sj_m): a Bloom filter in blocks of one 64-bit word; a hash sets three bits of its word."""
    return hashes.groupBy(_word(words).alias("__sj_w")).agg(F.bit_or(_bits()).alias("__sj_m"))


def _word(words: int):
    return F.pmod(F.col("__sj_a"), F.lit(words))


def _bits():
    return F.expr(" | ".join(f"shiftleft(1L, int(shiftright(__sj_b, {k}) & 63L))" for k in (0, 6, 12)))


def candidates(keyed: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """The rows whose hash is one of the ``n`` shared ones.

    Few hashes are broadcast: no row is shuffled. Of many, a Bloom filter of
    fixed size is broadcast and tested in the scan, so that only rows it lets
    through (the candidates and a few others) are shuffled to the hashes."""
    if n <= BROADCAST_HASHES:
        return keyed.join(F.broadcast(shared), ["__sj_a", "__sj_b"], "left_semi")
    bloom = F.broadcast(bloom_filter(shared, BLOOM_WORDS))  # at most BLOOM_WORDS rows
    passed = keyed.join(bloom, _word(BLOOM_WORDS) == F.col("__sj_w")).where(F.col("__sj_m").bitwiseAND(_bits()) == _bits())
    # an inner join: a semi join would be pushed below the filter, and shuffle the table
    return passed.drop("__sj_w", "__sj_m").join(shared.hint("merge"), ["__sj_a", "__sj_b"])


def repeated_rows(t: Table, hashed=row_hash) -> DataFrame:
    """Row ids of rows that repeat an earlier row (by row id) in every column, nulls equal.

    A hash and the row id of every row are grouped; full rows are read again
    and compared only where a hash is shared. A hash whose rows are all equal,
    as they are but for a collision, then stands for them; rows of other
    hashes are matched to their groups by all columns, so a collision costs
    time, never a wrong answer."""
    return _repeat_ids(_Repeats(t, hashed))


def _repeat_ids(found: _Repeats) -> DataFrame:
    if not found.hashes:
        return found.t.df.select(RID).limit(0)
    repeats = found.alike().select("__sj_a", "__sj_b", RID)
    if found.mixed is not None:
        repeats = repeats.join(F.broadcast(found.mixed), ["__sj_a", "__sj_b"], "left_anti")
    repeats = repeats.join(found.firsts(), ["__sj_a", "__sj_b"]).where(F.col(RID) > F.col("__sj_first")).select(RID)
    if found.mixed is None:
        return repeats
    names = {c: f"__sj_g{i}" for i, c in enumerate(found.t.columns)}
    first = found.unequal().groupBy(*[col(c).alias(g) for c, g in names.items()]).agg(F.min(RID).alias("__sj_first"))
    same = F.col(RID) > F.col("__sj_first")
    for c, g in names.items():
        same = same & col(c).eqNullSafe(F.col(g))
    return repeats.unionByName(found.unequal().join(first, same).select(RID))


def without_repeats(t: Table, hashed=row_hash) -> DataFrame:
    """``t.df`` without the rows of ``repeated_rows``: few shared hashes are a
    filter of the scan by broadcast; of many, the repeats' row ids leave by an anti join."""
    found = _Repeats(t, hashed)
    if not found.hashes:
        return t.df
    if found.mixed is None and found.hashes <= BROADCAST_HASHES:
        kept = found.keyed.join(found.firsts(), ["__sj_a", "__sj_b"], "left").where(F.col("__sj_first").isNull() | (F.col(RID) <= F.col("__sj_first")))
        return kept.select(*[col(c) for c in t.df.columns])
    return t.df.join(small_side(staged(_repeat_ids(found), "repeats")), RID, "left_anti")


def duplicate_count(t: Table, hashed=row_hash) -> DataFrame:
    """One row ``duplicates``: rows repeating an earlier row in every column (nulls equal)."""
    found = _Repeats(t, hashed)
    repeats = found.rows - found.hashes
    if found.mixed is not None:  # each further distinct row of a hash is a first one too
        kinds = found.unequal().select("__sj_a", "__sj_b", *[col(c) for c in t.columns]).distinct().groupBy("__sj_a", "__sj_b").count()
        repeats -= kinds.agg(F.sum(F.col("count") - 1)).first()[0]
    return t.df.sparkSession.createDataFrame([(repeats,)], "duplicates long")


def dataset_summary(t: Table) -> DataFrame:
    """``(total_rows, total_cols, total_missing, duplicates)``."""
    null_cells = sum((F.when(col(c).isNull(), 1).otherwise(0) for c in t.columns), F.lit(0))
    repeats = duplicate_count(t).first()["duplicates"]
    return t.df.agg(F.count(F.lit(1)).alias("total_rows"), F.lit(len(t.columns)).cast("long").alias("total_cols"),
                    F.coalesce(F.sum(null_cells), F.lit(0)).cast("long").alias("total_missing"),
                    F.lit(repeats).cast("long").alias("duplicates"))
