"""Row-local recipes over Structured Streaming.

The reference has no streams.  Steps that are pure per-row projections or
filters (casts, case, trim, dates, typo maps, replace, filters, drops,
renames) carry over to an unbounded frame unchanged, so a recipe built and
checked on a static table can clean a stream.  Steps that need statistics,
order or global state (fills by mean/median/mode, outliers, dedup, sort,
ffill/bfill, row edits) are rejected up front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from scrubjay.functions.exprs import col
from scrubjay.operators.steps import ROW_LOCAL, apply_step, constant_fill
from scrubjay.plans.recipe import Recipe, Step
from scrubjay.plans.table import Table


def streamable(step: Step) -> bool:
    if step.type == "fill_missing":
        return step.params.get("method") in ("empty_string", "custom")
    if step.type in ("drop_missing_rows", "split_datetime"):  # the latter without its "nothing parses" check
        return True
    return step.type in ROW_LOCAL


def apply_to_stream(stream_df: DataFrame, steps) -> DataFrame:
    """Apply row-local steps (a Recipe or a list of Steps) to a streaming frame."""
    steps = steps.steps if isinstance(steps, Recipe) else tuple(steps)
    bad = [s.type for s in steps if not streamable(s)]
    if bad:
        raise ValueError(f"steps need the whole table and cannot run on a stream: {bad}")
    t = Table(stream_df)
    for s in steps:
        if s.type == "fill_missing":
            t = _fill_constant(t, s)
        elif s.type == "split_datetime":
            t = apply_step(t, "split_datetime_unchecked", s.column, s.params)
        else:
            t = apply_step(t, s.type, s.column, s.params)
    return t.df


def _fill_constant(t: Table, s: Step) -> Table:
    cols = [s.column] if s.column else t.columns
    method, value = s.params.get("method"), s.params.get("value")
    if method == "custom" and value is None:
        return t
    return t.with_df(t.df.select(*[constant_fill(col(c), t.dtype(c), method, value).alias(c) if c in cols else col(c)
                                   for c in t.df.columns]))


def clean_stream(spark, source_path: str, schema, steps, sink_path: str, checkpoint_path: str,
                 fmt: str = "parquet", available_now: bool = True):
    """Read new files from ``source_path``, clean them, append to ``sink_path``.

    ``checkpoint_path`` must be shared storage on a cluster (offsets and
    commits live there, so a restarted query resumes where it stopped)."""
    src = spark.readStream.schema(schema).format(fmt).load(source_path)
    cleaned = apply_to_stream(src, steps)
    w = (cleaned.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint_path).outputMode("append"))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
