"""Data behind the charts (V1-V11).  Drawing is left to the caller; every
function returns an aggregate DataFrame (an empty one with the same schema
when there is nothing to draw) or a small pair of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubjay.functions.exprs import (col, epoch_nanos, is_datetime_type, is_numeric_type, is_string_type, pround,
                                      round_half_away, safe_corr, to_num)
from scrubjay.functions.moments import correlations
from scrubjay.functions.quantiles import grouped_quantiles, quantiles, value_stats
from scrubjay.operators.profile import QUARTILES, capped_distinct, histogram, numeric_columns
from scrubjay.plans.table import RID, Table

# Chart limits.
BAR_TOP = 15
PIE_TOP = 8
BOX_GROUPS = 10
BOX_LABEL_CHARS = 15
CORR_MAX_COLUMNS = 12
CATEGORY_MAX_DISTINCT = 20
AUTO_HISTOGRAMS, AUTO_BARS, AUTO_BAR_MAX_DISTINCT = 3, 2, 30


def _num(t: Table, name: str):
    return to_num(col(name), t.dtype(name))


# -- V1 -----------------------------------------------------------------------------------------
def chart_histogram(t: Table, column: str) -> DataFrame:
    """``min(50, max(10, n // 20))`` equal-width bins and the mean marker."""
    return histogram(t, column, rule="chart")


# -- V2 / V3 ------------------------------------------------------------------------------------
def bar_counts(t: Table, column: str, k: int = BAR_TOP) -> DataFrame:
    c = col(column)
    return (t.df.where(c.isNotNull()).groupBy(c.cast("string").alias("category"))
            .agg(F.count("*").cast("double").alias("value"))
            .orderBy(F.col("value").desc(), F.col("category").asc()).limit(k))


def bar_mean(t: Table, column: str, value_column: str | None = None, k: int = BAR_TOP) -> DataFrame:
    """Mean of the coerced numeric ``value_column`` per category, largest 15;
    categories without a numeric value are dropped.  Empty frame -> nothing
    numeric to average.  Falls back to counts without a distinct value column."""
    if not value_column or value_column == column or value_column not in t.columns:
        return bar_counts(t, column, k)
    c = col(column)
    means = (t.df.where(c.isNotNull()).groupBy(c.cast("string").alias("category"))
             .agg(F.avg(_num(t, value_column)).alias("value"))
             .where(F.col("value").isNotNull()))
    return means.orderBy(F.col("value").desc(), F.col("category").asc()).limit(k)


# -- V4 -------------------------------------------------------------------------------------------
def scatter_fit(t: Table, x: str, y: str) -> DataFrame:
    """Least-squares line and Pearson r over rows where both values exist."""
    xv, yv = _num(t, x), _num(t, y)
    both = t.df.select(xv.alias("x"), yv.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    n = F.count("*")
    return both.agg(
        n.alias("n"),
        F.when(n >= 2, F.regr_slope("y", "x")).alias("slope"),
        F.when(n >= 2, F.regr_intercept("y", "x")).alias("intercept"),
        F.when(n >= 2, round_half_away(safe_corr(F.col("x"), F.col("y")), 3)).alias("r"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"))


def scatter_points(t: Table, x: str, y: str) -> DataFrame:
    """Every plotted point (lazy; the caller decides how to render it)."""
    return (t.df.select(F.col(RID), _num(t, x).alias("x"), _num(t, y).alias("y"))
            .where(F.col("x").isNotNull() & F.col("y").isNotNull()))


#: Points of a thinned scatter; rows of the last histogram bucket that are pulled to place the cut among them.
SCATTER_CAP, CUT_ROWS = 5_000, 4_096
#: Bits of the hash that thins points (the leading 60 of md5), and bits told apart by one histogram.
HASH_BITS, STEP_BITS = 60, 12


def scatter_thin(t: Table, x: str, y: str, cap: int = SCATTER_CAP) -> DataFrame:
    """``(_rid, x, y)`` of ``cap`` plotted points, or of all if there are fewer:
    those with the smallest hash of their row id, so the choice is spread evenly
    and does not depend on partitions.

    No sort: histograms of the hash's leading bits (``2 ** STEP_BITS`` counts
    each) narrow the cut down to a bucket of a few rows, and only their hashes
    are pulled; the points themselves are one filter on the scan."""
    points = scatter_points(t, x, y).withColumn(
        "__sj_h", F.conv(F.substring(F.md5(F.col(RID).cast("string")), 1, HASH_BITS // 4), 16, 10).cast("long"))
    h, left, low, bits = F.col("__sj_h"), cap, 0, HASH_BITS
    inside = points
    while bits > 0:
        bits -= STEP_BITS
        bucket = F.shiftright(h, bits).bitwiseAND(F.lit((1 << STEP_BITS) - 1))
        counts = {r["b"]: r["n"] for r in inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}
        if bits == HASH_BITS - STEP_BITS and sum(counts.values()) <= cap:
            return points.drop("__sj_h")
        for b in sorted(counts):
            if counts[b] >= left:
                break
            left -= counts[b]
        low |= b << bits
        inside = points.where((h >= F.lit(low)) & (h < F.lit(low + (1 << bits))))
        if counts[b] <= CUT_ROWS:
            break
    # the cut lies among the rows of one bucket: (hash, row id) of the last point kept; ties go by row id
    last = sorted(tuple(r) for r in inside.select(h, RID).orderBy(h, RID).limit(left).collect())[-1:] if left else []
    if not last:
        return points.where(h < F.lit(low)).drop("__sj_h")
    return points.where((h < F.lit(last[0][0])) | ((h == F.lit(last[0][0])) & (F.col(RID) <= F.lit(last[0][1])))).drop("__sj_h")


# -- V5 ---------------------------------------------------------------------------------------------
BOX_SCHEMA = ("grp string, label string, n long, min double, q1 double, median double, q3 double, "
              "max double, whisk_lo double, whisk_hi double, n_fliers long")


def _r4(x):
    return pround(x, 4)


def box(t: Table, value: str, group: str | None = None, method: str = "exact") -> DataFrame:
    """Box statistics with 1.5 IQR whiskers, for the first 10 groups in key
    order (or the whole column).  Groups share every pass: open quantile
    brackets and fences are relations of one row a group, joined by group."""
    if group:
        return _box_groups(t, value, group, method)
    v = _num(t, value)
    stats, _ = value_stats(t.df, [(0, v, None)], QUARTILES)
    st, q = stats[0], quantiles(t.df, [(0, v, None)], QUARTILES, method=method, stats=stats)[0]
    w = (None, None, 0)
    if st.n:
        lo, hi = _fences(*q)
        inside = (v >= F.lit(lo)) & (v <= F.lit(hi))
        w = tuple(t.df.agg(F.min(F.when(inside, v)), F.max(F.when(inside, v)), F.count(F.when(~inside, 1))).first())
    row = (None, None, st.n, _r4(st.lo), *map(_r4, q), _r4(st.hi), _r4(w[0]), _r4(w[1]), w[2])
    return t.df.sparkSession.createDataFrame([row], BOX_SCHEMA)


def _fences(q1: float, median: float, q3: float) -> tuple[float, float]:
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def _box_groups(t: Table, value: str, group: str, method: str) -> DataFrame:
    spark, v = t.df.sparkSession, _num(t, value).cast("double")
    rows = t.df.select(col(group).alias("k"), F.when(~F.isnan(v), v).alias("v")).where("k IS NOT NULL")
    first = rows.groupBy("k").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("k").limit(BOX_GROUPS).collect()
    stats = {r["k"]: (r["n"], r["lo"], r["hi"]) for r in first}
    if method == "approx":
        keys = F.col("k").isin(list(stats))
        sketched = rows.where(keys).groupBy("k").agg(F.percentile_approx("v", QUARTILES, 10_000).alias("q")).collect()
        qs = {r["k"]: r["q"] or [None] * 3 for r in sketched}
    else:
        qs = grouped_quantiles(rows, F.col("v"), F.col("k"), QUARTILES, stats)
    kind = t.dtype(group)
    fences = spark.createDataFrame([(k, *_fences(*qs[k])) for k, (n, _, _) in stats.items() if n], T.StructType(
        [T.StructField("g", kind), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    whiskers = (rows.where("v IS NOT NULL").join(F.broadcast(fences), F.col("k") == F.col("g")).groupBy("g")  # BOX_GROUPS rows at most
                .agg(F.min(F.when(inside, F.col("v"))).alias("a"), F.max(F.when(inside, F.col("v"))).alias("b"), F.count(F.when(~inside, 1)).alias("n")))
    w = {r["g"]: (r["a"], r["b"], r["n"]) for r in whiskers.collect()}
    out = []
    for k, (n, lo, hi) in stats.items():
        a, b, fliers = w.get(k, (None, None, 0))
        out.append((str(k), str(k)[:BOX_LABEL_CHARS], n, _r4(lo), *map(_r4, qs[k]), _r4(hi), _r4(a), _r4(b), fliers))
    return spark.createDataFrame(out, BOX_SCHEMA)


# -- V6 ------------------------------------------------------------------------------------------------
def line(t: Table, y: str, x: str | None = None) -> DataFrame:
    """Points in drawing order: by ``x`` (then row id) when x is a datetime,
    otherwise the table's current order.  ``pos`` is the drawing position."""
    yv = _num(t, y)
    if x and x in t.columns and is_datetime_type(t.dtype(x)):
        base = t.df.select(F.col(RID), col(x).alias("x"), yv.alias("y"))
        from scrubjay.sources.rowid import with_row_id
        return with_row_id(base, order_by=[F.col("x").asc_nulls_last(), F.col(RID).asc()], name="pos")
    pos = t.positions("pos")
    xv = col(x).cast("string") if x and x in t.columns else F.col("pos").cast("string")
    return pos.select(F.col(RID), xv.alias("x"), yv.alias("y"), F.col("pos"))


#: Buckets of a thinned line: about the pixels that a chart is wide.
LINE_BUCKETS = 1_000


def line_thin(t: Table, y: str, x: str | None = None, buckets: int = LINE_BUCKETS) -> DataFrame:
    """``(_rid, x, y, bucket)``: at most four points for each of ``buckets``
    equal stretches of the drawing axis, the first, last, lowest and highest, so
    a line through them covers the same pixels as one through all points.

    The axis is a datetime ``x``, else the table's order (the row id where no
    other order is set: no positions are computed).  Points need both values.
    Of equal points the smallest row id is first, lowest or highest, the largest
    is last.  Two grouped scans of plain minima and maxima; the first one's
    result, a row a bucket, is joined to the second by broadcast, and so are
    the row ids found to the rows."""
    yv = _num(t, y)
    if x and x in t.columns and is_datetime_type(t.dtype(x)):
        base = t.df.select(F.col(RID), epoch_nanos(col(x), t.dtype(x)).alias("a"), yv.alias("y"), col(x).alias("x"))
    else:
        df, axis = (t.positions("__sj_pos"), F.col("__sj_pos")) if t.order else (t.df, F.col(RID))
        label = col(x).cast("string") if x and x in t.columns else axis.cast("string")
        base = df.select(F.col(RID), axis.alias("a"), yv.alias("y"), label.alias("x"))
    base = base.where(F.col("a").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y"))
    ends = base.agg(F.min("a").alias("lo"), F.max("a").alias("hi")).first()
    low, width = (ends["lo"], (ends["hi"] - ends["lo"]) // buckets + 1) if ends["lo"] is not None else (0, 1)
    base = base.withColumn("bucket", F.expr(f"(a - {low}L) div {width}L"))
    most = base.groupBy("bucket").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    met = base.join(F.broadcast(most.withColumnRenamed("bucket", "__sj_b")), F.col("bucket") == F.col("__sj_b"))
    at = [F.col("a") == F.col("a0"), F.col("a") == F.col("a1"), F.col("y") == F.col("y0"), F.col("y") == F.col("y1")]
    ids = [(F.max if k == 1 else F.min)(F.when(c, F.col(RID))) for k, c in enumerate(at)]
    picked = met.groupBy("bucket").agg(F.array(*ids).alias("ids")).select(F.explode("ids").alias("__sj_id")).distinct()
    return base.join(F.broadcast(picked), F.col(RID) == F.col("__sj_id"), "left_semi").select(RID, "x", "y", "bucket")


# -- V7 -------------------------------------------------------------------------------------------------
def corr_matrix(t: Table, max_columns: int = CORR_MAX_COLUMNS) -> DataFrame:
    """Pairwise-complete Pearson matrix of the first 12 numeric columns, as
    ``(col_x, col_y, r)`` (null for a constant column).  Plain sums in
    bounded-width aggregates; at most 144 result rows."""
    cols = numeric_columns(t)[:max_columns]
    spark = t.df.sparkSession
    schema = "col_x string, col_y string, r double"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    rs = correlations(t.df, {c: col(c).cast("double") for c in cols})
    rows = []
    for (a, b), r in rs.items():
        rows.append((a, b, pround(r, 4)))
        if a != b:
            rows.append((b, a, pround(r, 4)))
    return spark.createDataFrame(rows, schema)


# -- V8 / V9 ----------------------------------------------------------------------------------------------
def _with_share(top: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.lit(0))  # over <= 8 rows
    return top.withColumn("share_pct", round_half_away(F.col("value") / F.sum("value").over(w) * 100, 1))


def pie_counts(t: Table, column: str, k: int = PIE_TOP) -> DataFrame:
    return _with_share(bar_counts(t, column, k))


def pie_sum(t: Table, column: str, value_column: str | None = None, k: int = PIE_TOP) -> DataFrame:
    """Sum of the coerced value per category: top 8 first, then positive only."""
    if not value_column or value_column == column or value_column not in t.columns:
        return pie_counts(t, column, k)
    c = col(column)
    sums = (t.df.where(c.isNotNull()).groupBy(c.cast("string").alias("category"))
            .agg(F.coalesce(F.sum(_num(t, value_column)), F.lit(0.0)).alias("value")))
    top = sums.orderBy(F.col("value").desc(), F.col("category").asc()).limit(k).where(F.col("value") > 0)
    return _with_share(top)


# -- V11 ----------------------------------------------------------------------------------------------------
def chart_slots(t: Table) -> DataFrame:
    """``(column, is_num, is_cat)``: numeric slot for numbers; category slot
    for non-numbers and numbers with at most 20 distinct values."""
    cols = t.columns
    nums = [c for c in cols if is_numeric_type(t.dtype(c))]
    d = capped_distinct(t.df, nums, CATEGORY_MAX_DISTINCT)
    rows = [(c, c in d, c not in d or d[c] <= CATEGORY_MAX_DISTINCT) for c in cols]
    return t.df.sparkSession.createDataFrame(rows, "column string, is_num boolean, is_cat boolean")


# Each chart's slots, what they take (number, category, any column) and whether they must be filled.
CHART_SLOTS = [("histogram", "x", "num", True), ("bar", "x", "cat", True), ("bar", "y", "num", False), ("scatter", "x", "num", True),
               ("scatter", "y", "num", True), ("box", "x", "cat", False), ("box", "y", "num", True), ("line", "x", "any", False),
               ("line", "y", "num", True), ("pie", "x", "cat", True), ("pie", "y", "num", False)]


def chart_options(t: Table) -> DataFrame:
    """``(chart, slot, required, column)``: the columns that suit every slot of every chart."""
    kinds = chart_slots(t).select("column", F.explode(F.array(F.lit("any"), F.when(F.col("is_num"), "num"), F.when(F.col("is_cat"), "cat"))).alias("kind"))
    slots = t.df.sparkSession.createDataFrame(CHART_SLOTS, "chart string, slot string, kind string, required boolean")
    return kinds.where("kind IS NOT NULL").join(F.broadcast(slots), "kind").select("chart", "slot", "required", "column")


# -- V10 -------------------------------------------------------------------------------------------------------
AUTO_SCHEMA = "chart string, column string, label string, value double"


def auto_charts(t: Table) -> DataFrame:
    """Histograms of the first 3 numeric columns, bar counts of the first 2
    text columns with at most 30 distinct values, and the correlation matrix
    when there are 2+ numeric columns, as one long frame."""
    nums = numeric_columns(t)
    texts = [c for c in t.columns if is_string_type(t.dtype(c))][:AUTO_BARS]
    parts = []
    for c in nums[:AUTO_HISTOGRAMS]:
        h = chart_histogram(t, c)
        parts.append(h.select(F.lit("histogram").alias("chart"), "column",
                              F.col("bin").cast("string").alias("label"), F.col("count").cast("double").alias("value")))
    if texts:
        d = capped_distinct(t.df, texts, AUTO_BAR_MAX_DISTINCT)
        for c in texts:
            if d[c] <= AUTO_BAR_MAX_DISTINCT:
                parts.append(bar_counts(t, c).select(F.lit("bar").alias("chart"), F.lit(c).alias("column"),
                                                     F.col("category").alias("label"), "value"))
    if len(nums) >= 2:
        parts.append(corr_matrix(t).select(F.lit("heatmap").alias("chart"), F.col("col_x").alias("column"),
                                           F.col("col_y").alias("label"), F.col("r").alias("value")))
    if not parts:
        return t.df.sparkSession.createDataFrame([], AUTO_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
