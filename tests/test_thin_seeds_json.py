"""Thinned charts, seeded and grouped quantiles, JSON ids in file order."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import scrubjay.functions.quantiles as q
from scrubjay.operators import charts, profile
from scrubjay.plans.table import RID, Table
from scrubjay.sources.files import read_records_json

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def column(spark, x):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in x], "v double").repartition(6)


DISTS = {"uniform": lambda r: r.uniform(-5, 5, 6000), "skewed": lambda r: r.lognormal(0, 3, 6000), "ties": lambda r: r.integers(0, 3, 6000),
         "hot": lambda r: np.where(r.random(6000) < 0.4, 7.0, r.normal(size=6000)), "constant": lambda r: np.full(50, 2.5), "two": lambda r: np.array([1.0, 4.0])}


def passes(monkeypatch):
    """Counts the passes that follow the seeded one."""
    seen = []
    cells = q._Columns.cells
    monkeypatch.setattr(q._Columns, "cells", lambda self, brackets, bins=None: (seen.append(len(brackets)), cells(self, brackets, bins))[1])
    return seen


@pytest.mark.parametrize("dist", sorted(DISTS))
def test_seeds_solve_every_rank_in_one_more_pass(spark, dist, monkeypatch):
    x = DISTS[dist](np.random.default_rng(1)).astype(float)
    seen = passes(monkeypatch)
    found, counted = q.summaries(column(spark, [*x, None]), [("v", F.col("v"), None)], PROBS, extra={"rows": F.lit(1), "some": F.col("v")})
    st, squares, got = found["v"]
    assert got == pytest.approx(list(np.quantile(x, PROBS)), rel=1e-12, abs=1e-12) and seen == []
    assert st.n == len(x) and squares == pytest.approx(((x - x.mean()) ** 2).sum()) and counted == {"rows": len(x) + 1, "some": len(x)}


@pytest.mark.parametrize("seeds", [((-9e9, -8e9),) * 6, ((8e9, 9e9),) * 6, ((0.1, 0.1),) * 6, ((-9e9, 9e9),), ((-1.0, 0.5), (0.2, 1.0), (0.5, 0.5))])
def test_wrong_seeds_cost_passes_not_results(spark, seeds, monkeypatch):
    x = DISTS["hot"](np.random.default_rng(2))
    df = column(spark, x)
    stats = {"v": q.Stats(len(x), float(x.sum()), float(x.min()), float(x.max()), seeds)}
    monkeypatch.setattr(q, "FINAL_ROWS", 40)
    monkeypatch.setattr(q, "SEED_ROWS", 64)
    assert q.exact_quantiles(df, [("v", F.col("v"), None)], PROBS, stats) == {"v": pytest.approx(list(np.quantile(x, PROBS)), rel=1e-12, abs=1e-12)}


def test_many_columns_infinities_and_empty_columns(spark):
    rng = random.Random(3)
    rows = [(rng.random(), None, rng.choice([float("inf"), float("-inf"), 1.0, 2.0, None]), float("nan") if k % 2 else 3.0, k) for k in range(900)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e int").repartition(5)
    found, _ = q.summaries(df, [(c, F.col(c), None) for c in "abcde"], [0.5])
    x = sorted(r[2] for r in rows if r[2] is not None)
    mid = (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
    assert found["a"][2] == [pytest.approx(float(np.median([r[0] for r in rows])))]
    assert found["b"][2] == [None] and found["b"][1] is None and found["c"][2] == [mid] and found["d"][2] == [3.0] and found["e"][2] == [449.5]
    assert q.summaries(df, [], [0.5], extra={"n": F.lit(1)}) == ({}, {"n": 900})


def test_profile_reads_the_table_twice(spark, monkeypatch):
    rng = np.random.default_rng(4)
    t = Table(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)))], f"{RID} long, a double, b double"))
    seen = passes(monkeypatch)
    rows = {r["column"]: r for r in profile.numeric_summary(t).collect()}
    assert seen == [] and set(rows) == {"a", "b"}


@pytest.mark.parametrize("final", [4096, 8])
def test_grouped_quantiles_match_numpy(spark, final, monkeypatch):
    monkeypatch.setattr(q, "FINAL_ROWS", final)
    rng = np.random.default_rng(5)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot"]), float(rng.lognormal(0, 2))) for _ in range(4000)]
    rows = [(str(g), v) for g, v in rows] + [("one", 3.0), ("none", None), (None, 1.0), ("inf", float("inf")), ("inf", float("-inf")), ("inf", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    stats = {r["g"]: (r["n"], r["lo"], r["hi"]) for r in df.where("g IS NOT NULL").groupBy("g").agg(
        F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    got = q.grouped_quantiles(df, F.col("v"), F.col("g"), [0.25, 0.5, 0.75], stats)
    for g in ("a", "b", "hot", "one"):
        assert got[g] == pytest.approx(list(np.quantile([v for k, v in rows if k == g], [0.25, 0.5, 0.75])), rel=1e-12)
    assert got["none"] == [None] * 3 and got["inf"][1] == 2.0


def test_the_plan_does_not_grow_with_the_groups(spark):
    df = spark.createDataFrame([(f"g{i % 9}", float(i)) for i in range(500)], "g string, v double")

    def plan(n):
        cells = q._Groups(df, F.col("v"), F.col("g"), [f"g{i}" for i in range(n)]).cells([(i, 0.0, 500.0) for i in range(n)], [(0.0, 1.0)] * n)
        return cells._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert plan(2) == plan(9)


def test_box_of_groups_with_few_values(spark):
    t = Table(spark.createDataFrame([(0, "x", None), (1, "y", 1.0), (2, "y", 2.0), (3, "y", 100.0), (4, "y", 3.0), (5, None, 9.0)], f"{RID} long, g string, v double"))
    rows = {r["grp"]: r for r in charts.box(t, "v", "g").collect()}
    assert rows["x"]["n"] == 0 and rows["x"]["q1"] is None and rows["x"]["n_fliers"] == 0
    assert rows["y"]["whisk_hi"] == 3.0 and rows["y"]["n_fliers"] == 1 and rows["y"]["median"] == 2.5
    none = charts.box(Table(t.df.where("v > 1000")), "v", "g")
    assert none.count() == 0 and charts.box(Table(t.df.where("v > 1000")), "v").collect()[0]["n"] == 0


# -- thinned charts ---------------------------------------------------------------------------------
def points(spark, n=700, seed=6):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, i // 5 * 0.5]), rng.choice([None, float(rng.randrange(9)), 4.0]), f"2024-01-{1 + rng.randrange(28):02}") for i in range(n)]
    return rows, Table(spark.createDataFrame(rows, f"{RID} long, x double, y double, d string").withColumn("d", F.to_date("d")))


@pytest.mark.parametrize("cap,bits,step,cut", [(50, 60, 12, 4096), (50, 60, 4, 0), (60, 8, 4, 0), (0, 60, 12, 4096), (10_000, 60, 12, 4096)])
def test_scatter_keeps_the_smallest_hashes_whatever_the_partitions(spark, monkeypatch, cap, bits, step, cut):
    import hashlib
    for name, value in (("HASH_BITS", bits), ("STEP_BITS", step), ("CUT_ROWS", cut)):
        monkeypatch.setattr(charts, name, value)
    rows, t = points(spark)
    both = sorted((hashlib.md5(str(i).encode()).hexdigest()[:bits // 4], i) for i, x, y, _ in rows if x is not None and y is not None)
    want = {i for _, i in both[:cap]}
    for n in (1, 7):
        out = charts.scatter_thin(t.with_df(t.df.repartition(n)), "x", "y", cap)
        assert out.columns == [RID, "x", "y"] and {r[RID] for r in out.collect()} == want


def plain_thin(rows, buckets):
    """rows: (rid, axis, y) -> ids of each bucket's first, last, lowest and highest point."""
    low, high = min(a for _, a, _ in rows), max(a for _, a, _ in rows)
    width = (high - low) // buckets + 1
    per = {}
    for r in rows:
        per.setdefault((r[1] - low) // width, []).append(r)
    return {f[0] for p in per.values() for f in (min(p, key=lambda r: (r[1], r[0])), max(p, key=lambda r: (r[1], r[0])),
                                                 min(p, key=lambda r: (r[2], r[0])), min(p, key=lambda r: (-r[2], r[0])))}


@pytest.mark.parametrize("buckets", [1, 5, 40])
def test_line_keeps_first_last_lowest_and_highest(spark, buckets):
    rows, t = points(spark)
    by_id = charts.line_thin(t, "y", None, buckets)
    assert {r[RID] for r in by_id.collect()} == plain_thin([(i, i, y) for i, _, y, _ in rows if y is not None], buckets)
    by_day = charts.line_thin(t.with_df(t.df.repartition(5)), "y", "d", buckets)
    day = 86_400 * 10 ** 9
    assert {r[RID] for r in by_day.collect()} == plain_thin([(i, int(d[-2:]) * day, y) for i, _, y, d in rows if y is not None], buckets)
    assert by_day.count() <= 4 * buckets
    turned = Table(t.df, (("x", False),))
    at = {r[RID]: r["pos"] for r in charts.line(turned, "y").collect()}
    assert {r[RID] for r in charts.line_thin(turned, "y", None, buckets).collect()} == plain_thin([(i, at[i], y) for i, _, y, _ in rows if y is not None], buckets)


def test_a_thin_line_needs_neither_sorts_nor_positions(spark):
    _, t = points(spark)
    plan = charts.line_thin(t, "y", "d", 10)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Window" not in plan and "rangepartitioning" not in plan
    assert charts.line_thin(Table(t.df.where("y > 1000")), "y", "d").count() == 0


# -- JSON ids ---------------------------------------------------------------------------------------
def test_json_lines_are_numbered_in_path_order(spark, tmp_dir):
    sizes = {"a.json": 5, "b.json": 5000, "c.json": 3}
    want, k = {}, 0
    for name, n in sizes.items():
        with open(f"{tmp_dir}/{name}", "w") as f:
            for i in range(n):
                f.write(json.dumps({"at": f"{name}{i}", "o": {"k": k}}) + "\n")
                want[f"{name}{i}"] = k
                k += 1
    for pack in ("4194304", "20000"):  # files packed together, and cut into splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", pack)
        try:
            got = {r["at"]: (r[RID], r["o.k"]) for r in read_records_json(spark, tmp_dir).df.collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == {at: (i, i) for at, i in want.items()}


def test_wrapped_records_are_numbered_by_their_place(spark, tmp_dir):
    k, want = 0, []
    for name, lists in (("a", [3, 0, 1]), ("b", [400, 2])):
        with open(f"{tmp_dir}/{name}.json", "w") as f:
            for n in lists:
                f.write(json.dumps({"data": [{"v": k + i} for i in range(n)]}) + "\n")
                want += [(k + i, k + i) for i in range(n)]
                k += n
    assert sorted((r[RID], r["v"]) for r in read_records_json(spark, tmp_dir).df.collect()) == want


def test_other_faults_of_a_frame_are_not_hidden(spark, tmp_dir):
    from scrubjay.sources.rowid import with_load_order_id
    assert [r["id"] for r in with_load_order_id(spark.range(3).toDF("x"), "id").orderBy("x").collect()] == [0, 1, 2]
