"""Steps, recipes, findings: pandas differential checks and invariants."""

import difflib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrubjay.operators import quality as Q
from scrubjay.operators.fills import directional_fill
from scrubjay.operators.patches import apply_patches, drop_rows
from scrubjay.operators.profile import histogram, top_values
from scrubjay.operators.steps import apply_step, mode_values
from scrubjay.plans.recipe import Recipe, Step, diff_cells, validate
from scrubjay.plans.table import RID, Table
from scrubjay.suite.base import fixture
from tests.conftest import SF_SMALL


def small_table(spark, rows, schema, parts=3):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    return Table.from_df(df, rid="id")


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("parts", [1, 7])
def test_ffill_bfill_match_pandas_across_blocks(spark, forward, parts):
    rnd = random.Random(11)
    vals = [None if rnd.random() < 0.7 else float(i) for i in range(400)]
    t = small_table(spark, [(i, v) for i, v in enumerate(vals)], "id long, v double", parts)
    got = directional_fill(t, ["v"], forward=forward, block_rows=17).df.orderBy(RID).select("v").collect()
    s = pd.Series(vals, dtype="float64")
    want = s.ffill() if forward else s.bfill()
    assert [r[0] for r in got] == [None if pd.isna(x) else x for x in want]


def test_ffill_follows_sort_order(spark):
    rows = [(0, 2, None), (1, 1, 5.0), (2, 2, 7.0), (3, 1, None), (4, 3, None)]
    t = small_table(spark, rows, "id long, k long, v double")
    t = apply_step(t, "sort_values", "k", {"direction": "asc"})
    got = {r[RID]: r["v"] for r in apply_step(t, "fill_missing", "v", {"method": "ffill"}).df.collect()}
    # order by k, id: 1(5) 3(None->5) 0(None->5) 2(7) 4(None->7)
    assert got == {1: 5.0, 3: 5.0, 0: 5.0, 2: 7.0, 4: 7.0}


def test_mode_ties_take_smallest(spark):
    t = small_table(spark, [(i, v) for i, v in enumerate(["b", "a", "b", "a", "c"])], "id long, v string")
    assert mode_values(t, ["v"]) == {"v": "a"}


def test_dedup_keeps_first_and_is_idempotent(spark):
    rows = [(0, "x", None), (1, "y", 1), (2, "x", None), (3, "y", 1), (4, "y", 2)]
    t = small_table(spark, rows, "id long, a string, b long")
    once = apply_step(t, "remove_duplicates")
    assert sorted(r[RID] for r in once.df.collect()) == [0, 1, 4]
    twice = apply_step(once, "remove_duplicates")
    assert sorted(r[RID] for r in twice.df.collect()) == [0, 1, 4]


def test_histogram_bins_sum_to_non_null_count_and_match_numpy(spark):
    import numpy as np
    rnd = np.random.default_rng(5)
    x = rnd.lognormal(0, 1, 997)
    t = small_table(spark, [(i, float(v)) for i, v in enumerate(x)] + [(2000, None)], "id long, v double")
    h = histogram(t, "v").orderBy("bin").collect()
    counts, edges = np.histogram(x, bins=24)
    assert sum(r["count"] for r in h) == 997
    assert [r["count"] for r in h] == list(counts)
    const = small_table(spark, [(i, 3.0) for i in range(5)], "id long, v double")
    hc = histogram(const, "v").collect()
    assert len(hc) == 1 and hc[0]["bin_lo"] == 2.5 and hc[0]["bin_hi"] == 3.5 and hc[0]["count"] == 5


def test_top_values_ties_by_value(spark):
    t = small_table(spark, [(i, v) for i, v in enumerate("bbaacd")], "id long, v string")
    got = [(r["value"], r["count"]) for r in top_values(t, k=3).orderBy("rank").collect()]
    assert got == [("a", 2), ("b", 2), ("c", 1)]


def test_filters_keep_reference_semantics(spark):
    rows = [(0, "View"), (1, None), (2, "click"), (3, "view")]
    t = small_table(spark, rows, "id long, e string")
    ne = apply_step(t, "filter_rows", "e", {"condition": "not_equals", "value": "view"})
    assert sorted(r[RID] for r in ne.df.collect()) == [0, 1, 2]  # nulls kept
    ct = apply_step(t, "filter_rows", "e", {"condition": "contains", "value": "^v"})
    assert sorted(r[RID] for r in ct.df.collect()) == [0, 3]  # case-insensitive regex


def test_patches_last_seq_wins_and_null_patch(spark):
    t = small_table(spark, [(0, 1.0, "a"), (1, 2.0, "b")], "id long, v double, s string")
    p = spark.createDataFrame([(0, "v", "abc", 1), (0, "v", "9", 2), (1, "s", "", 0)],
                              "_rid long, column string, value string, seq long")
    out = {r[RID]: (r["v"], r["s"]) for r in apply_patches(t, p).df.collect()}
    assert out == {0: (9.0, "a"), 1: (2.0, None)}
    bad = spark.createDataFrame([(5, "v", "1", 0)], "_rid long, column string, value string, seq long")
    with pytest.raises(ValueError):
        apply_patches(t, bad)
    with pytest.raises(ValueError):
        drop_rows(t, [7])


def test_recipe_dry_run_equals_apply_and_undo_restores(spark):
    t = fixture(spark, SF_SMALL, "ev_dirty")
    r = Recipe(t).append(Step("fill_missing", "value", {"method": "zero"}))
    step = Step("standardize_case", "type_case", {"case": "lower"})
    metrics, cells = r.dry_run(step)
    r2, applied = r.apply(step)
    assert metrics == applied
    assert cells.count() == min(6, metrics["cells_changed"])
    undone, failed = r2.undo(1)
    assert failed == []
    cols = r.result.columns
    a = r.result.df.select(RID, *cols).exceptAll(undone.result.df.select(RID, *cols))
    assert a.count() == 0


def test_recipe_json_roundtrip_and_validation(spark):
    t = fixture(spark, SF_SMALL, "ev_dirty")
    r = Recipe(t).append(Step("rename_column", "event_type", {"new_name": "kind"}))
    text = r.to_json()
    again = Recipe.from_json(t, text)
    assert again.result.columns == r.result.columns
    assert r.to_dataframe(spark).count() == 1
    with pytest.raises(ValueError):
        validate(Step("bogus", "value"), t)
    with pytest.raises(ValueError):
        validate(Step("sort_values", None, {"direction": "asc"}), t)
    with pytest.raises(KeyError):
        validate(Step("drop_column", "nope"), t)


def test_diff_marks_type_change(spark):
    t = small_table(spark, [(0, "1"), (1, None), (2, "x")], "id long, s string")
    after = apply_step(t, "convert_type", "s", {"target": "numeric"})
    changed = sorted(r[RID] for r in diff_cells(t, after).collect())
    assert changed == [0, 2]  # every cell not null on both sides


def test_typos_difflib_brute_force(spark):
    """The rows-only typo query against get_close_matches on the same data."""
    t = fixture(spark, SF_SMALL, "ev_dirty")
    got = {(r["value"], r["match"]) for r in Q.typo_candidates(t, ["type_typo"]).collect()}
    vals = [r[0] for r in t.df.select("type_typo").collect() if r[0] is not None]
    vc = pd.Series(vals).value_counts()
    counts = vc.to_dict()
    canon = sorted(counts, key=lambda v: (-counts[v], v))[:30]
    want = set()
    for v in counts:
        m = difflib.get_close_matches(v, [c for c in canon if c != v], n=1, cutoff=0.85)
        if m and counts[v] < counts[m[0]]:
            want.add((v, m[0]))
    assert got == want and len(got) == 5


def test_deep_page_uses_positions(spark, monkeypatch):
    import scrubjay.sources.pages as pages
    t = apply_step(fixture(spark, SF_SMALL, "ev_dirty"), "sort_values", "value", {"direction": "desc"})
    shallow = [r[RID] for r in pages.slice_rows(t, page=3, size=50).collect()]
    monkeypatch.setattr(pages, "TOP_K_MAX", 10)
    deep = [r[RID] for r in pages.slice_rows(t, page=3, size=50).collect()]
    assert sorted(shallow) == sorted(deep) and len(deep) == 50


def test_recipe_save_load_rerun(spark, tmp_dir):
    import os
    t = fixture(spark, SF_SMALL, "ev_dirty")
    r = Recipe(t).append(Step("trim_whitespace", "type_pad")).append(Step("drop_column", "date_text"))
    path = os.path.join(tmp_dir, "recipe")
    r.save(spark, path)
    again = Recipe.load(spark, t, path)
    assert [s.type for s in again.steps] == ["trim_whitespace", "drop_column"]
    assert again.result.df.exceptAll(r.result.df).count() == 0


def test_recipe_rerun_on_new_data(spark):
    from tests.conftest import SF_ORACLE
    steps = [Step("trim_whitespace", "type_pad"), Step("fill_missing", "value", {"method": "median"})]
    r = Recipe(fixture(spark, SF_SMALL, "ev_dirty"))
    for s in steps:
        r = r.append(s)
    bigger = r.rerun(fixture(spark, SF_ORACLE, "ev_dirty"))
    assert bigger.steps == r.steps
    assert bigger.result.df.count() > r.result.df.count()
    assert bigger.result.df.where("value IS NULL").count() == 0
