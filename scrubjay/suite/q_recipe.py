"""Recipe queries (R1-R7): chained steps, dry run, diff, undo, reset, JSON replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubjay.functions.exprs import round_half_away
from scrubjay.plans.recipe import Recipe, Step, diff_cells, diff_counts, diff_counts_tree
from scrubjay.session import scratch_path
from scrubjay.plans.table import RID
from scrubjay.suite import sqlfrag as S
from scrubjay.suite.base import fixture, out, query
from scrubjay.suite.q_steps import EV_COLS

EV = ("ev_dirty",)

CHAIN = [
    Step("trim_whitespace", "type_pad"),
    Step("standardize_case", "type_pad", {"case": "title"}),
    Step("fill_missing", "value", {"method": "median"}),
    Step("handle_outliers", "value", {"method": "cap"}),
    Step("filter_rows", "event_type", {"condition": "not_null"}),
    Step("drop_column", "date_text"),
]

CHAIN_SQL = f"""
WITH s1 AS (SELECT rid, {S.title(S.strip('type_pad'))} AS type_pad, value, event_type FROM ev_dirty),
med AS (SELECT quantile_cont(value, 0.5) AS m FROM s1),
s2 AS (SELECT rid, type_pad, coalesce(value, (SELECT m FROM med)) AS value, event_type FROM s1),
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s2),
s3 AS (SELECT rid, type_pad, CASE WHEN value IS NULL THEN NULL
              ELSE least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END AS value, event_type FROM s2, q)
SELECT rid, type_pad, round(value, 4) AS value, event_type FROM s3 WHERE event_type IS NOT NULL
"""


def _chain_out(t):
    return out(t, "type_pad", "value", "event_type").withColumn("value", round_half_away(F.col("value"), 4))


def _build(spark, sf, steps):
    r = Recipe(fixture(spark, sf, "ev_dirty"))
    for s in steps:
        r = r.append(s)
    return r


@query("recipe_chain", CHAIN_SQL, EV)
def recipe_chain(spark, sf):
    return _chain_out(_build(spark, sf, CHAIN).result)


@query("recipe_json_replay", CHAIN_SQL, EV)
def recipe_json_replay(spark, sf):
    text = Recipe(fixture(spark, sf, "ev_dirty"), CHAIN).to_json()
    return _chain_out(Recipe.from_json(fixture(spark, sf, "ev_dirty"), text).result)


@query("recipe_saved_replay", CHAIN_SQL, EV)
def recipe_saved_replay(spark, sf):
    """The step log written to shared storage, read back and replayed."""
    path = scratch_path(spark, "recipe")
    Recipe(fixture(spark, sf, "ev_dirty"), CHAIN).save(spark, path)
    return _chain_out(Recipe.load(spark, fixture(spark, sf, "ev_dirty"), path).result)


@query("recipe_dry_run",
       "WITH ch AS (SELECT rid, type_case AS before, upper(type_case) AS after FROM ev_dirty "
       "WHERE type_case IS DISTINCT FROM upper(type_case)), m AS (SELECT count(*) AS cells FROM ch) "
       "SELECT CAST(0 AS BIGINT) AS rows_removed, CAST(0 AS BIGINT) AS cols_removed, CAST(0 AS BIGINT) AS cols_added, "
       "m.cells AS cells_changed, 'type_case' AS column, rid, before, after "
       "FROM (SELECT * FROM ch ORDER BY rid LIMIT 6), m", EV)
def recipe_dry_run(spark, sf):
    r = Recipe(fixture(spark, sf, "ev_dirty"))
    metrics, cells = r.dry_run(Step("standardize_case", "type_case", {"case": "upper"}), sample=6)
    return cells.select(*[F.lit(metrics[k]).cast("long").alias(k)
                          for k in ("rows_removed", "cols_removed", "cols_added", "cells_changed")],
                        "column", F.col(RID).alias("rid"), "before", "after")


_FILLED = ["value", "value_sparse", "type_case", "event_type"]


@query("recipe_diff_counts",
       "SELECT * FROM (" + " UNION ALL ".join(
           f"SELECT '{c}' AS column, count(*) - count({c}) AS cells_changed FROM ev_dirty" for c in EV_COLS)
       + ") WHERE cells_changed > 0", EV)
def recipe_diff_counts(spark, sf):
    r = _build(spark, sf, [Step("fill_missing", None, {"method": "mode"})])
    return diff_counts(r.source, r.result)


@query("recipe_diff_tree",
       "SELECT * FROM (SELECT 'value' AS column, count(*) FILTER (WHERE value IS DISTINCT FROM 7.5) AS cells_changed FROM ev_dirty WHERE rid < 40 AND rid % 5 <> 0 "
       "UNION ALL SELECT 'type_pad', count(*) FILTER (WHERE type_pad IS DISTINCT FROM 'seen') FROM ev_dirty WHERE rid < 40 AND rid % 5 <> 0) WHERE cells_changed > 0", EV)
def recipe_diff_tree(spark, sf):
    """A table against its copy with a few patched cells and dropped rows: hashes of row ranges lead to the unequal ones."""
    r = Recipe(fixture(spark, sf, "ev_dirty"))
    patches = r.source.df.where(F.col(RID) < 40).select(RID, F.explode(F.array(
        F.struct(F.lit("value").alias("column"), F.lit("7.5").alias("value")),
        F.struct(F.lit("type_pad").alias("column"), F.lit("seen").alias("value")))).alias("p")).select(RID, "p.*", F.lit(0).alias("seq"))
    r = r.append(Step("apply_patches", None, {"patches": patches})).append(Step("drop_rows", None, {"rows": list(range(0, 40, 5))}))
    return diff_counts_tree(r.source, r.result, leaf=64, fan=8)


@query("recipe_diff_cells",
       f"SELECT 'num_text' AS column, 4 AS col_ord, rid, num_text AS before, CAST({S.num('num_text')} AS VARCHAR) AS after "
       f"FROM ev_dirty WHERE NOT (num_text IS NULL AND {S.num('num_text')} IS NULL)", EV)
def recipe_diff_cells(spark, sf):
    r = _build(spark, sf, [Step("convert_type", "num_text", {"target": "numeric"})])
    return diff_cells(r.source, r.result).withColumnRenamed(RID, "rid")


UNDO_STEPS = [Step("fill_missing", "value", {"method": "zero"}),
              Step("rename_column", "event_type", {"new_name": "kind"}),
              Step("standardize_case", "kind", {"case": "upper"})]


@query("recipe_undo", "SELECT rid, value, upper(event_type) AS kind FROM ev_dirty", EV)
def recipe_undo(spark, sf):
    r, failed = _build(spark, sf, UNDO_STEPS).undo(0)
    return out(r.result, "value", "kind")


INDEPENDENT = [Step("fill_missing", "value_sparse", {"method": "zero"}),
               Step("fill_missing", "value", {"method": "median"}),
               Step("fill_missing", "event_type", {"method": "mode"}),
               Step("handle_outliers", "value", {"method": "cap"})]


@query("recipe_undo_independent",
       """WITH m AS (SELECT quantile_cont(value, 0.5) AS med FROM ev_dirty),
k AS (SELECT event_type AS top FROM ev_dirty WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1),
f AS (SELECT rid, value_sparse, coalesce(value, (SELECT med FROM m)) AS value, coalesce(event_type, (SELECT top FROM k)) AS event_type FROM ev_dirty),
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f)
SELECT rid, value_sparse, round(least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 4) AS value, event_type,
 CAST(0 AS BIGINT) AS n_statistics FROM f, q""", EV)
def recipe_undo_independent(spark, sf):
    """Undoing a fill that no later step depends on: ``n_statistics`` counts what the replay had to compute again."""
    r = _build(spark, sf, INDEPENDENT)
    before = len(r.source.lineage.computed)
    undone, _ = r.undo(0)
    return (out(undone.result, "value_sparse", "value", "event_type").withColumn("value", round_half_away(F.col("value"), 4))
            .withColumn("n_statistics", F.lit(len(undone.source.lineage.computed) - before).cast("long")))


@query("recipe_undo_dependent",
       "SELECT rid, coalesce(value, 0.0) AS value, event_type, CAST(1 AS BIGINT) AS n_failed FROM ev_dirty", EV)
def recipe_undo_dependent(spark, sf):
    """Undoing the rename makes the later step on the new name fail; it is
    dropped and reported."""
    r, failed = _build(spark, sf, UNDO_STEPS).undo(1)
    return out(r.result, "value", "event_type").withColumn("n_failed", F.lit(len(failed)).cast("long"))


@query("recipe_reset", "SELECT * FROM ev_dirty", EV)
def recipe_reset(spark, sf):
    return out(_build(spark, sf, CHAIN).reset().result)


@query("recipe_apply_metrics",
       "SELECT count(*) FILTER (WHERE event_type IS NULL) AS rows_removed, CAST(0 AS BIGINT) AS cells_changed, "
       "CAST(0 AS BIGINT) AS cols_removed, CAST(0 AS BIGINT) AS cols_added FROM ev_dirty", EV)
def recipe_apply_metrics(spark, sf):
    """R1: applying a step reports rows removed and cells changed."""
    r = Recipe(fixture(spark, sf, "ev_dirty"))
    _, m = r.apply(Step("filter_rows", "event_type", {"condition": "not_null"}))
    return spark.range(1).select(*[F.lit(m[k]).cast("long").alias(k)
                                   for k in ("rows_removed", "cells_changed", "cols_removed", "cols_added")])
