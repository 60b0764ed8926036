"""Remembered statistics of recipes, pages by fences, diffs by hash tree."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from scrubjay.operators.steps import apply_step
from scrubjay.plans.lineage import Lineage
from scrubjay.plans.recipe import Recipe, Step, diff_counts, diff_counts_tree
from scrubjay.plans.table import RID, Table
from scrubjay.sources.pages import fence_index, slice_rows


def _jobs(spark, run):
    """How many Spark jobs ``run`` starts."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def _table(spark, n=2000):
    rows = [(i, float(i % 37) if i % 5 else None, float(i % 11) if i % 7 else None, f"w{i % 3}" if i % 4 else None,
             datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i % 97)) for i in range(n)]
    return Table(spark.createDataFrame(rows, f"{RID} long, a double, b double, w string, ts timestamp_ntz"))


STEPS = [Step("fill_missing", "a", {"method": "mean"}), Step("fill_missing", "b", {"method": "median"}),
         Step("handle_outliers", "b", {"method": "cap"}), Step("fill_missing", "w", {"method": "mode"}),
         Step("split_datetime", "ts", {"components": ["day"]}), Step("handle_outliers", "a", {"method": "zscore"})]


def _rows(t):
    return sorted(t.df.select(*sorted(t.df.columns)).collect())


def _same_as_anew(t, recipe):
    anew = Table(t.df)
    for s in recipe.steps:
        anew = apply_step(anew, s.type, s.column, s.params)
    return _rows(anew) == _rows(recipe.result)


def test_undo_computes_only_what_depends(spark):
    t = _table(spark)
    r = Recipe(t)
    for s in STEPS:
        r = r.append(s)
    done = r.source.lineage.computed
    total = len(done)
    assert _jobs(spark, lambda: r.undo(0)) > 0  # its outliers of a depend on the fill of a
    assert done[total:] == ["zscore"]
    assert _jobs(spark, lambda: r.undo(5)) == 0  # the last step: nothing depends on it
    assert _jobs(spark, lambda: r.undo(3)) == 0
    assert _jobs(spark, lambda: r.undo(1)) > 0
    assert done[total + 1:] == ["quartiles"]
    assert all(_same_as_anew(t, r.undo(i)[0]) for i in range(len(STEPS)))


def test_undoing_a_row_filter_computes_all_again(spark):
    t = _table(spark)
    r = Recipe(t).append(Step("filter_rows", "a", {"condition": "less_than", "value": 20})).append(STEPS[1]).append(STEPS[3])
    total = len(r.source.lineage.computed)
    undone, _ = r.undo(0)
    assert len(r.source.lineage.computed) == 2 * total and _same_as_anew(t, undone)


def test_versions(spark):
    base = Lineage.of(["a", "b"])
    fill = base.after("fill_missing", "a", {"method": "mean"}, ["a", "b"], ["a", "b"])
    assert fill.columns["b"] == base.columns["b"] and fill.columns["a"] != base.columns["a"] and fill.rows == base.rows
    named = fill.after("rename_column", "a", {"new_name": "c"}, ["a", "b"], ["c", "b"])
    assert named.columns["c"] == fill.columns["a"] and set(named.columns) == {"c", "b"}
    assert base.after("filter_rows", "a", {"condition": "not_null"}, ["a", "b"], ["a", "b"]).rows != base.rows
    split = Lineage.of(["d", "d_year"]).after("split_datetime", "d", {"components": ["year"]}, ["d", "d_year"], ["d", "d_year"])
    assert split.columns["d_year"] != "source:d_year" and split.columns["d"] == "source:d"
    # a directional fill follows the sort keys' values, written or not
    sort = base.after("sort_values", "b", {}, ["a", "b"], ["a", "b"])
    other = sort.after("convert_type", "b", {"target": "string"}, ["a", "b"], ["a", "b"])
    ffill = ("fill_missing", "a", {"method": "ffill"}, ["a", "b"], ["a", "b"])
    assert sort.after(*ffill).columns["a"] != other.after(*ffill).columns["a"]
    patch = ("apply_patches", None, {"patches": object()}, ["a", "b"], ["a", "b"])
    assert base.after(*patch).columns["a"] != base.after(*patch).columns["a"]
    assert Recipe(_table(spark)).result.with_df(spark.range(1)).lineage is None


@pytest.mark.parametrize("order", [(), (("a", True),), (("w", False), ("a", True)), (("ts", False), ("b", False)), (("w", True), ("ts", True))])
def test_pages_by_fences(spark, order):
    t = Table(_table(spark, 700).df.repartition(5), order)
    fences = fence_index(t, every=64)
    want = [r[RID] for r in t.ordered().collect()]
    for page, size in ((0, 50), (1, 64), (3, 100), (6, 100), (7, 100), (13, 53), (40, 100)):
        got = slice_rows(t, page, size, pos="at", fences=fences).collect()
        assert [r[RID] for r in got] == want[page * size:(page + 1) * size]
        assert [r["at"] for r in got] == list(range(page * size, min(len(want), (page + 1) * size)))


def test_a_page_by_fences_computes_no_positions(spark):
    t = Table(_table(spark, 700).df, (("a", True),))
    fences = fence_index(t, every=64)
    page = slice_rows(t, 5, 100, fences=fences)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Join" not in plan and "TakeOrdered" in plan
    with pytest.raises(ValueError):
        slice_rows(Table(t.df, (("a", False),)), 5, 100, fences=fences)
    assert fence_index(Table(t.df.limit(0), (("a", True),))).between(0, 10)[0].count() == 0


def test_diff_by_hash_tree(spark):
    t = _table(spark, 3000)
    zeros = t.with_df(t.df.withColumn("z", F.when(F.col(RID) % 2 == 0, 0.0)))
    cases = [
        (t, t),
        (t, t.with_df(t.df.where(F.col(RID) % 3 != 0))),
        (t, t.with_df(t.df.withColumn("a", F.when(F.col(RID) == 1500, 99.0).otherwise(F.col("a"))))),
        (t, t.with_df(t.df.withColumn("w", F.when(F.col(RID).between(100, 180), None).otherwise(F.col("w"))).withColumn("b", F.coalesce("b", F.lit(0.0))))),
        (t, apply_step(t, "convert_type", "a", {"target": "string"})),
        (t, t.with_df(t.df.withColumn("a", F.col("a").cast("long")))),
        (zeros, zeros.with_df(zeros.df.withColumn("z", -F.col("z")))),
        (t, t.with_df(t.df.limit(0))),
        (t, t.with_df(t.df.drop("a", "b", "w", "ts"))),
    ]
    for before, after in cases:
        want = sorted(map(tuple, diff_counts(before, after).collect()))
        assert sorted(map(tuple, diff_counts_tree(before, after, leaf=16, fan=8).collect())) == want
