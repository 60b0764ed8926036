"""S8: one page of rows by position in the current order.

Deep pages look up positions, or read one range of the order between two
fences: the sort keys of every 100,000th row, staged once by ``fence_index``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubjay.functions.exprs import col, is_datetime_type, to_str
from scrubjay.plans.table import RID, Table
from scrubjay.session import staged

# Up to this many leading rows a page is a distributed top-k (each task keeps
# at most start + size rows); deeper pages look up their positions.
TOP_K_MAX = 100_000

# Rows between two fences.
FENCE_EVERY = 100_000


@dataclass(frozen=True)
class Fences:
    """``frame``: (``__sj_pos``, one text a sort key, row id) of every ``every``-th row of ``table``'s order."""
    table: Table
    frame: DataFrame
    every: int

    @property
    def keys(self) -> list[tuple]:
        return [(c, asc) for c, asc in self.table.order if c in self.table.df.columns]

    def between(self, start: int, end: int) -> tuple[DataFrame, int]:
        """(rows of the fence ranges that hold positions ``start`` to ``end``, the first one's position)."""
        at = F.col("__sj_pos")
        low = self.frame.where(at <= start).orderBy(at.desc()).first()
        high = self.frame.where(at >= end).orderBy(at).first()
        df = self.table.df
        if low is not None and low["__sj_pos"]:
            df = df.where(~self._before(low))
        return (df.where(self._before(high)) if high is not None else df), (low["__sj_pos"] if low is not None else 0)

    def _before(self, fence) -> Column:
        """Whether a row comes before the fence: key by key, nulls last, the row id in the end."""
        same, out = F.lit(True), F.lit(False)
        for i, (c, asc) in enumerate(self.keys):
            dt, text, v = self.table.dtype(c), fence[f"__sj_k{i}"], col(c)
            if text is None:
                less, equal = v.isNotNull(), v.isNull()
            else:
                bound = F.lit(text).cast(dt)
                less = v.isNotNull() & ((v < bound) if asc else (v > bound))
                equal = v.isNotNull() & (v == bound)
            out, same = out | (same & less), same & equal
        return F.coalesce(out | (same & (F.col(RID) < F.lit(fence[RID]))), F.lit(False))


def fence_index(t: Table, every: int = FENCE_EVERY) -> Fences:
    """Stage the fences of ``t``'s current order: positions are computed once,
    whatever number of pages ``slice_rows(..., fences=...)`` reads later.

    Sort keys must be of types whose text casts back (numbers, text, booleans,
    dates, timestamps)."""
    keys = [c for c, _ in t.order if c in t.df.columns]
    for c in keys:
        if isinstance(t.dtype(c), (T.ArrayType, T.StructType, T.MapType, T.BinaryType)):
            raise TypeError(f"no fences over {c!r}: its values have no text that casts back")
    at = t.position_index("__sj_pos").where(F.col("__sj_pos") % int(every) == 0)
    picked = t.df.select(RID, *[col(c).cast("string").alias(f"__sj_k{i}") for i, c in enumerate(keys)])
    return Fences(t, staged(picked.join(at, RID), "fences"), int(every))


def slice_rows(t: Table, page: int = 0, size: int = 100, pos: str | None = None, top_k_max: int = TOP_K_MAX,
               changed: DataFrame | None = None, fences: Fences | None = None) -> DataFrame:
    """Rows ``[page*size, (page+1)*size)`` of the current order, in that order.

    Timestamps render as text; nothing but the page reaches the driver.
    ``pos`` names a column for each row's position. ``changed`` takes the
    cells of ``diff_cells``: the page then has ``_changed``, the sorted names
    of each row's changed columns. ``fences``, made by ``fence_index`` of the
    same table, lets any page read its own range of the order alone."""
    start, size = int(page) * int(size), int(size)
    if fences is not None and fences.table != t:
        raise ValueError("these fences belong to another table or order")
    placed = True
    if fences is not None or start + size <= top_k_max:
        rows, skipped = fences.between(start, start + size) if fences is not None else (t.df, 0)
        picked = rows.orderBy(*t.sort_exprs()).offset(start - skipped).limit(size)
        placed = bool(pos)
        if pos:  # a window over one page
            picked = picked.withColumn("__sj_pos", F.row_number().over(Window.orderBy(*t.sort_exprs())).cast("long") + F.lit(start - 1))
    else:  # at most one page of rows: the table itself is not shuffled
        index = t.position_index("__sj_pos").where((F.col("__sj_pos") >= start) & (F.col("__sj_pos") < start + size))
        picked = t.df.join(F.broadcast(index), RID).orderBy("__sj_pos")
    if changed is not None:
        marks = (changed.join(F.broadcast(picked.select(RID)), RID, "left_semi").groupBy(RID)
                 .agg(F.sort_array(F.collect_set("column")).alias("__sj_changed")))
        order = ["__sj_pos"] if placed else t.sort_exprs()
        picked = picked.join(F.broadcast(marks), RID, "left").orderBy(*order)
    out = []
    for f in picked.schema.fields:
        if f.name == "__sj_pos":
            if pos:
                out.append(F.col("__sj_pos").alias(pos))
        elif f.name == "__sj_changed":
            out.append(F.coalesce("__sj_changed", F.array().cast("array<string>")).alias("_changed"))
        elif f.name == RID:
            out.append(F.col(RID))
        elif is_datetime_type(f.dataType):
            out.append(to_str(col(f.name), f.dataType).alias(f.name))
        else:
            out.append(col(f.name))
    return picked.select(*out)
