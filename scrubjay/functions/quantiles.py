"""Exact, distributed quantiles (linear interpolation, as pandas and DuckDB).

Spark's exact ``percentile`` aggregate merges a value->count map of the whole
column into one buffer, which does not hold for a high-cardinality column at
scale.  Instead we select order statistics by refinement:

1. one aggregate gives ``n``, ``min`` and ``max`` per target, and with it a KLL
   sketch's values a little below and above every wanted rank (``value_stats``);
2. a seeded pass counts what lies in, between and outside these narrow ranges,
   the ranges themselves in ``SEED_BINS`` bins with exact min and max.  Seeds
   are only a guess: a rank outside its range is found among the counts of the
   zone it lies in, and goes on as an ordinary bracket;
3. each rank still open owns a value bracket ``[lo, hi]`` and the number of
   rows below it; a pass buckets only the rows inside open brackets into
   ``BINS`` equal-width bins (``groupBy(probe, bin)`` with count/min/max, a
   partial aggregation that copes with hot values) and narrows every bracket
   to the bin holding its rank;
4. a bracket of equal values or of two rows is solved by its min and max; one
   of at most ``FINAL_ROWS`` rows by pulling those few values to the driver;
5. a bracket still large after ``MAX_PASSES`` (values spread over hundreds of
   binary orders of magnitude) is ranked by range-partitioned positions.

Each pass is a column-pruned scan; the driver only ever sees histogram rows
(at most ``BINS`` a bracket, ``SEED_ROWS`` in the seeded pass) or
``FINAL_ROWS`` values a bracket (this grows with the columns, groups and ranks
asked for, never with rows).  Targets are columns, each with a condition if
need be, or the groups of one column: then open brackets are a small relation
joined to the rows by group, and the plan does not grow with the groups.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 4096
FINAL_ROWS = 4096
MAX_PASSES = 16
#: Bins of a seeded range at most, and rows of a seeded pass that reach the driver at most.
SEED_BINS, SEED_ROWS = 16_384, 400_000
#: Size parameter of the sketch, and the share of the rows that a seeded range reaches below and above its
#: rank: about twice the sketch's rank error at that size (2.446 / KLL_K ** 0.9433, 99 % confidence).
KLL_K, SEED_REACH = 8192, 0.001
#: Reducers that merge the tasks' sketches before the last one, and columns sketched in one aggregate.
KLL_SALTS, KLL_COLUMNS = 64, 16


@dataclass
class _Bracket:
    target: int
    lo: float
    hi: float
    below: int
    count: int


@dataclass(frozen=True)
class Stats:
    """One target's count, sum, bounds and seeded ranges (one per probability)."""

    n: int
    total: float | None
    lo: float | None
    hi: float | None
    seeds: tuple = ()

    @property
    def mean(self) -> float | None:
        return self.total / self.n if self.n else None


def _value(v: Column, cond: Column | None) -> Column:
    v = v.cast("double")
    v = F.when(~F.isnan(v), v)
    return v if cond is None else F.when(cond, v)


def value_stats(df: DataFrame, targets, probs, extra: dict | None = None) -> tuple[dict, dict]:
    """``({key: Stats}, {name: value})`` in one pass: bounds and sketch seeds of every target, and the counts
    ``extra`` (``{name: Column counted}``).

    Sketches merge in two steps, first within ``KLL_SALTS`` groups of tasks, so
    that no single reducer takes one from every task."""
    found, counted = {}, {}
    ranks = [r for p in probs for r in (max(0.0, p - SEED_REACH), min(1.0, p + SEED_REACH))]
    targets, extra = list(targets), dict(extra or {})
    for a in range(0, max(1, len(targets)), KLL_COLUMNS):
        part = targets[a:a + KLL_COLUMNS]
        first, last = [], []
        for i, (_, v, cond) in enumerate(part):
            v = _value(v, cond)
            first += [F.count(v).alias(f"n{i}"), F.sum(v).alias(f"s{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                      F.kll_sketch_agg_double(v, F.lit(KLL_K)).alias(f"k{i}")]
            merged = F.kll_merge_agg_double(f"k{i}", F.lit(KLL_K))
            seeds = F.kll_sketch_get_quantile_double(merged, F.array(*map(F.lit, ranks)))
            last += [F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}"), F.sum(f"s{i}").alias(f"s{i}"), F.min(f"lo{i}").alias(f"lo{i}"),
                     F.max(f"hi{i}").alias(f"hi{i}"), F.when(F.sum(f"n{i}") > 0, seeds).alias(f"k{i}")]
        names = list(extra) if a == 0 else []
        first += [F.count(extra[c]).alias(f"x{j}") for j, c in enumerate(names)]
        last += [F.coalesce(F.sum(f"x{j}"), F.lit(0)).alias(f"x{j}") for j in range(len(names))]
        if not first:
            break
        salt = F.pmod(F.spark_partition_id(), F.lit(KLL_SALTS))
        row = df.withColumn("__sj_salt", salt).groupBy("__sj_salt").agg(*first).agg(*last).first()
        for i, (key, _, _) in enumerate(part):
            k = row[f"k{i}"]
            seeds = tuple(zip(k[::2], k[1::2], strict=True)) if k else ()
            found[key] = Stats(row[f"n{i}"], row[f"s{i}"], row[f"lo{i}"], row[f"hi{i}"], seeds)
        counted.update({c: row[f"x{j}"] for j, c in enumerate(names)})
    return found, counted


class _Columns:
    """Targets that are columns: a row gives one cell for every bracket it lies in."""

    def __init__(self, df: DataFrame, vals: list):
        # values first: brackets name each several times
        self.df = df.select(*(v.alias(f"v{i}") for i, v in enumerate(vals)))
        self.vals = [F.col(f"v{i}") for i in range(len(vals))]

    def cells(self, brackets, bins=None) -> DataFrame:
        """(p, v) of every row in a bracket, p its place in the list; with ``bins`` (floor, scale) also the bin b."""
        entries = []
        for p, (t, lo, hi, *_) in enumerate(brackets):
            v = self.vals[t]
            cell = [F.lit(p).alias("p"), v.alias("v")] + ([_bin(v, *map(F.lit, bins[p])).alias("b")] if bins else [])
            entries.append(F.when(_in_bracket(v, F.lit(lo), F.lit(hi)), F.struct(*cell)))
        return self.df.select(F.explode(F.array(*entries)).alias("e")).where("e IS NOT NULL").select("e.*")


class _Groups:
    """Targets that are the groups of one column: open brackets are a relation joined by group."""

    def __init__(self, df: DataFrame, value: Column, group: Column, keys: list):
        self.rows = df.select(group.alias("k"), _value(value, None).alias("v")).where("k IS NOT NULL AND v IS NOT NULL")
        self.keys = keys

    def cells(self, brackets, bins=None) -> DataFrame:
        schema = T.StructType([T.StructField("bk", self.rows.schema["k"].dataType), T.StructField("p", T.IntegerType()),
                               *(T.StructField(c, T.DoubleType()) for c in ("lo", "hi", "floor", "scale"))])
        relation = [(self.keys[t], p, float(lo), float(hi), *(map(float, bins[p]) if bins else (0.0, 0.0)))
                    for p, (t, lo, hi, *_) in enumerate(brackets)]
        # a row a bracket: as many as groups and ranks were asked for
        sides = F.broadcast(self.rows.sparkSession.createDataFrame(relation, schema))
        inside = (F.col("k") == F.col("bk")) & _in_bracket(F.col("v"), F.col("lo"), F.col("hi"))
        b = [_bin(F.col("v"), F.col("floor"), F.col("scale")).alias("b")] if bins else []
        return self.rows.join(sides, inside).select("p", "v", *b)


def _in_bracket(v: Column, lo: Column, hi: Column) -> Column:
    return (v >= lo) & (v <= hi)


def _bin(v: Column, low: Column, scale: Column) -> Column:
    return (F.when(v == float("-inf"), F.lit(-1)).when(v == float("inf"), F.lit(BINS))
            .otherwise(F.least(F.floor((v - low) * scale), F.lit(BINS - 1))).cast("int"))


def exact_quantiles(df: DataFrame, targets, probs, stats=None, squares: dict | None = None):
    """Exact quantiles for several targets in shared passes.

    ``targets``: list of ``(key, value Column, condition Column | None)``.
    ``stats``: optional ``{key: (n, min, max) or Stats}`` already computed by
    the caller.  With ``Stats`` of every target, ``squares`` receives the sums
    of squared deviations from the means, taken in the seeded pass.
    Returns ``{key: [value or None per prob]}``.
    """
    vals = [_value(v, cond) for _, v, cond in targets]
    if stats is None:
        stats, _ = value_stats(df, targets, probs)
    stats = {k: s if isinstance(s, Stats) else Stats(s[0], None, s[1], s[2]) for k, s in stats.items()}
    search, source = _Search([stats[k] for k, _, _ in targets], probs), _Columns(df, vals)
    seeded = search.intervals()
    if seeded or squares is not None:
        sums = search.seeded_pass(source, seeded, squares is not None)
        if squares is not None:
            squares.update({k: sums.get(i, 0.0) if stats[k].n else None for i, (k, _, _) in enumerate(targets)})
    search.run(source)
    return {k: search.result(i) for i, (k, _, _) in enumerate(targets)}


def grouped_quantiles(df: DataFrame, value: Column, group: Column, probs, stats: dict) -> dict:
    """Exact quantiles of ``value`` for the groups in ``stats`` (``{key: (n, min, max)}``): ``{key: [value or None per prob]}``."""
    keys = list(stats)
    search = _Search([Stats(stats[k][0], None, stats[k][1], stats[k][2]) for k in keys], probs)
    search.run(_Groups(df, value, group, keys))
    return {k: search.result(i) for i, k in enumerate(keys)}


class _Search:
    """The ranks wanted, those solved, and the brackets of the others."""

    def __init__(self, stats: list[Stats], probs):
        self.stats, self.wanted = stats, len(probs)
        self.solved: dict[tuple[int, int], float] = {}
        self.open: dict[tuple[int, int], _Bracket] = {}
        self.plan: list = []
        for i, s in enumerate(stats):
            if not s.n:
                self.plan.append(None)
                continue
            plan = []
            for p in map(float, probs):
                h = (s.n - 1) * p
                r0, r1 = int(math.floor(h)), int(math.ceil(h))
                plan.append((r0, r1, h - r0))
                for r in (r0, r1):
                    if s.lo == s.hi:
                        self.solved[i, r] = s.lo
                    else:
                        self.open[i, r] = _Bracket(i, s.lo, s.hi, 0, s.n)
            self.plan.append(plan)

    def result(self, i: int) -> list:
        if self.plan[i] is None:
            return [None] * self.wanted
        out = []
        for r0, r1, frac in self.plan[i]:
            a, b = self.solved[i, r0], self.solved[i, r1]
            out.append(a if r0 == r1 else a + (b - a) * frac)
        return out

    def settle(self, key: tuple[int, int], bins: list, below: int) -> None:
        """``bins``: (n, min, max) in rising order from rank ``below`` on."""
        local, acc = key[1] - below, 0
        for n, mn, mx in bins:
            if local < acc + n:
                if mn == mx or n == 2:
                    self.solved[key] = mn if local == acc else mx
                    self.open.pop(key)
                else:
                    self.open[key] = _Bracket(key[0], mn, mx, below + acc, n)
                return
            acc += n
        raise RuntimeError("quantile rank outside its bracket")  # pragma: no cover - counts always cover the rank

    # -- the seeded pass ------------------------------------------------------------------------
    def intervals(self) -> dict[int, list[tuple[float, float]]]:
        """Disjoint seeded ranges of each target that has open ranks, finite ends only."""
        out = {}
        for i, s in enumerate(self.stats):
            if any(t == i for t, _ in self.open) and s.seeds and all(map(math.isfinite, (s.lo, s.hi))):
                merged: list[list[float]] = []
                for lo, hi in sorted(s.seeds):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                out[i] = [(lo, hi) for lo, hi in merged]
        return out

    def seeded_pass(self, source: _Columns, seeded: dict, squares: bool) -> dict[int, float]:
        """Settle ranks by the counts of all zones; the sums of squared deviations by target."""
        ranges = max(1, sum(map(len, seeded.values())))
        bins = max(64, min(SEED_BINS, SEED_ROWS // ranges))
        entries, cols = [], [i for i, s in enumerate(self.stats) if s.n and (squares or i in seeded)]
        for i in cols:
            v, code, base = source.vals[i], None, 0
            for lo, hi in seeded.get(i, []):
                scale = bins / (hi - lo) if hi > lo and math.isfinite(bins / (hi - lo)) else 0.0
                below, inside = F.lit(base), F.least(F.floor((v - F.lit(lo)) * F.lit(scale)), F.lit(bins - 1)) + F.lit(base + 1)
                code = F.when(v < F.lit(lo), below) if code is None else code.when(v < F.lit(lo), below)
                code, base = code.when(v <= F.lit(hi), inside), base + bins + 1
            code = F.lit(0) if code is None else code.otherwise(F.lit(base))
            cell = [F.lit(i).alias("p"), code.cast("int").alias("b"), v.alias("v")]
            if squares:
                d = v - F.lit(self.stats[i].mean)
                cell.append((d * d).alias("d"))
            entries.append(F.when(v.isNotNull(), F.struct(*cell)))
        if not entries:
            return {}
        aggs = [F.count("*").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx")] + ([F.sum("d").alias("d")] if squares else [])
        rows = (source.df.select(F.explode(F.array(*entries)).alias("e")).where("e IS NOT NULL").select("e.*")
                .groupBy("p", "b").agg(*aggs).collect())
        per: dict[int, list] = {}
        sums: dict[int, float] = {}
        for r in sorted(rows, key=lambda r: (r["p"], r["b"])):
            per.setdefault(r["p"], []).append((r["n"], r["mn"], r["mx"]))
            if squares:
                sums[r["p"]] = sums.get(r["p"], 0.0) + r["d"]
        for key in [k for k in self.open if k[0] in seeded]:
            self.settle(key, per[key[0]], 0)
        return sums

    # -- refinement -----------------------------------------------------------------------------
    def run(self, source) -> None:
        passes = 0
        while self.open:
            passes += 1
            brackets: dict[tuple, list[tuple[int, int]]] = {}  # ranks sharing one bracket
            for key, b in self.open.items():
                brackets.setdefault((b.target, b.lo, b.hi, b.below, b.count), []).append(key)
            small = [bk for bk in brackets if bk[4] <= FINAL_ROWS]
            large = [bk for bk in brackets if bk[4] > FINAL_ROWS]
            if small:
                per: dict[int, list[float]] = {}
                for r in source.cells(small).collect():
                    per.setdefault(r["p"], []).append(r["v"])
                for p, bk in enumerate(small):
                    values = sorted(per[p])
                    for key in brackets[bk]:
                        self.solved[key] = values[key[1] - bk[3]]
                        del self.open[key]
            if large and passes > MAX_PASSES:
                # pathological spreads (values over hundreds of binary orders of
                # magnitude) shrink slowly under equal-width bins: rank by sort
                for bk in large:
                    self._by_sort(source, bk, brackets[bk])
            elif large:
                self._refine(source, large, brackets)

    def _refine(self, source, large: list, brackets: dict) -> None:
        ends = {p: (lo, hi) for p, (_, lo, hi, *_) in enumerate(large)}
        if any(math.isinf(lo) or math.isinf(hi) for lo, hi in ends.values()):
            finite = source.cells(large).where(F.abs("v") != float("inf")).groupBy("p").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
            ends = {p: (0.0, 0.0) for p in ends} | {r["p"]: (r["lo"], r["hi"]) for r in finite.collect()}
        bins = [(lo, BINS / (hi - lo) if hi > lo else 0.0) for lo, hi in ends.values()]
        hist = source.cells(large, bins).groupBy("p", "b").agg(F.count("*").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
        per: dict[int, list] = {}
        for r in sorted(hist.collect(), key=lambda r: (r["p"], r["b"])):
            per.setdefault(r["p"], []).append((r["n"], r["mn"], r["mx"]))
        for p, bk in enumerate(large):
            for key in brackets[bk]:
                self.settle(key, per[p], bk[3])

    def _by_sort(self, source, bk: tuple, keys: list) -> None:
        """Exact ranks inside one bracket via range-partitioned positions (no
        collection of the bracket); ties share a value, so the pick is exact."""
        from scrubjay.sources.rowid import with_row_id
        ranked = with_row_id(source.cells([bk]).select(F.col("v").alias("__sj_v")), order_by=[F.col("__sj_v").asc()], name="__sj_pos")
        wanted = sorted({key[1] - bk[3] for key in keys})
        found = {r["__sj_pos"]: r["__sj_v"] for r in ranked.where(F.col("__sj_pos").isin(wanted)).collect()}
        for key in keys:
            self.solved[key] = found[key[1] - bk[3]]
            del self.open[key]


def approx_quantiles(df: DataFrame, targets, probs, accuracy: int = 10000):
    """``percentile_approx`` for all targets in one aggregate (bounded memory)."""
    aggs = [F.percentile_approx(_value(v, cond), list(map(float, probs)), accuracy).alias(f"q{i}")
            for i, (_, v, cond) in enumerate(targets)]
    row = df.agg(*aggs).first()
    return {k: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
            for i, (k, _, _) in enumerate(targets)}


def quantiles(df: DataFrame, targets, probs, method: str = "exact", stats=None, accuracy: int = 10000):
    if not targets:
        return {}
    if method == "approx":
        return approx_quantiles(df, targets, probs, accuracy)
    return exact_quantiles(df, targets, probs, stats=stats)


def summaries(df: DataFrame, targets, probs, method: str = "exact", extra: dict | None = None) -> tuple[dict, dict]:
    """``({key: (Stats, sum of squared deviations, quantiles)}, {name: count})`` in two passes (a few more only
    where a seed failed or very many rows lie near a rank); ``extra`` as in ``value_stats``."""
    stats, counted = value_stats(df, targets, probs, extra)
    squares: dict = {}
    qs = exact_quantiles(df, targets, [] if method == "approx" else probs, stats, squares)
    if method == "approx" and targets:
        qs = approx_quantiles(df, targets, probs)
    return {k: (stats[k], squares.get(k), qs[k]) for k, _, _ in targets}, counted
