"""Forward / backward fill in current row order without a global window.

Rows are cut into blocks of consecutive keys, ``floor(key / block_rows)``, a
few blocks per core and never more than ``MAX_BLOCKS``.  The key is the row id
if its blocks, counted, are even; a sparse or clustered row id is replaced by
the dense position in the order, which makes every block ``block_rows`` rows.
After a sort the whole rows are range-partitioned by it and staged once: a
block is then a partition, and no join brings positions to rows.

1. Inside each block a running ``last(ignorenulls)`` window fills the gaps
   (backward fill runs the same frame in descending order: a frame ending at
   UNBOUNDED FOLLOWING would be re-evaluated per row).
2. Each block's edge value (its last non-null for ffill, first for bfill) comes
   from a hash aggregate of keys only (``max``/``min`` of longs) plus a
   broadcast join that picks those few rows, so the full data is never sorted
   for it.
3. A running ``last(ignorenulls)`` over the one-row-per-block frame gives the
   carry into each block, joined back by block (broadcast; the frame has at
   most ``MAX_BLOCKS`` rows).
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from scrubjay.functions.exprs import col
from scrubjay.operators.patches import small_side
from scrubjay.plans.table import RID, Table
from scrubjay.session import staged
from scrubjay.sources.rowid import staged_by

MIN_BLOCK_ROWS = 1 << 12
MAX_BLOCKS = 200_000
BLOCKS_PER_CORE = 4


def _target(rows: int, spark) -> int:
    cores = max(1, spark.sparkContext.defaultParallelism)
    return max(MIN_BLOCK_ROWS, math.ceil(rows / (cores * BLOCKS_PER_CORE)), math.ceil(rows / MAX_BLOCKS))


def _keyed(t: Table, block_rows: int | None):
    """(frame with ``__sj_blk``, name of the key within a block)."""
    spark = t.df.sparkSession
    span = t.df.agg(F.count(F.lit(1)).alias("n"), F.min(RID).alias("lo"), F.max(RID).alias("hi")).first()
    rows = block_rows or _target(span["n"], spark)
    if not t.order and span["n"]:
        width = max(rows, math.ceil((span["hi"] - span["lo"] + 1) / MAX_BLOCKS))
        block = F.expr(f"{RID} div {width}")
        # bounded by MAX_BLOCKS: the fullest block decides whether the row id will do
        fullest = t.df.groupBy(block.alias("b")).count().agg(F.max("count")).first()[0]
        if fullest <= 2 * rows:
            return t.df.withColumn("__sj_blk", block), RID
    if t.order and not block_rows:
        cores = max(1, spark.sparkContext.defaultParallelism)
        parts = min(MAX_BLOCKS, max(1, math.ceil(span["n"] / rows), min(cores, math.ceil(span["n"] / MIN_BLOCK_ROWS))))
        return staged_by(t.df, t.sort_exprs(), parts, "__sj_blk", "__sj_pos"), "__sj_pos"
    return t.positions("__sj_pos").withColumn("__sj_blk", F.expr(f"__sj_pos div {rows}")), "__sj_pos"


def directional_fill(t: Table, columns, forward: bool = True, block_rows: int | None = None) -> Table:
    df, key_name = _keyed(t, block_rows)
    key = F.col(key_name)
    w_in = Window.partitionBy("__sj_blk").orderBy(key.asc() if forward else key.desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    columns = list(columns)
    inner = {c: F.last(col(c), ignorenulls=True).over(w_in) for c in columns}

    # edge positions per block: a hash aggregate over longs
    pick = F.max if forward else F.min
    edge_pos = staged(df.groupBy("__sj_blk").agg(*[
        pick(F.when(col(c).isNotNull(), key)).alias(f"__sj_p{i}") for i, c in enumerate(columns)]), "edges")
    right = small_side(edge_pos)  # a row a block, a long a filled column
    # the rows at those positions (at most columns x blocks rows) carry the edge values
    hit = F.lit(False)
    for i in range(len(columns)):
        hit = hit | F.coalesce(key == F.col(f"__sj_p{i}"), F.lit(False))
    at_edge = df.join(right, "__sj_blk").where(hit)
    edges = at_edge.groupBy("__sj_blk").agg(*[
        F.first(F.when(key == F.col(f"__sj_p{i}"), col(c)), ignorenulls=True).alias(f"__sj_e{i}")
        for i, c in enumerate(columns)])
    blocks = edge_pos.select("__sj_blk").join(edges, "__sj_blk", "left")
    # one row per block: an unpartitioned running window over it is small
    w_blk = Window.orderBy(F.col("__sj_blk").asc() if forward else F.col("__sj_blk").desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    carry = staged(blocks.select("__sj_blk", *[
        F.last(f"__sj_e{i}", ignorenulls=True).over(w_blk).alias(f"__sj_c{i}")
        for i in range(len(columns))]), "carry")
    right = small_side(carry)  # carried values may be long texts
    filled = df.select(*[inner[c].alias(c) if c in inner else col(c) for c in df.columns])
    joined = filled.join(right, "__sj_blk", "left")
    out = []
    for c in t.df.columns:
        if c in inner:
            i = columns.index(c)
            out.append(F.coalesce(col(c), F.col(f"__sj_c{i}")).alias(c))
        else:
            out.append(col(c))
    return t.with_df(joined.select(*out))
