"""Row-targeted edits: bulk cell patches (W18), row drops (W15), header row (W16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubjay.functions.dates import to_ts
from scrubjay.functions.exprs import (col, is_datetime_type, is_integral_type, is_numeric_type,
                                      is_string_type, to_num, to_str)
from scrubjay.plans.table import RID, Table

# A side is broadcast when its rows, written as text, take this many bytes at most.
BROADCAST_BYTES_MAX = 32 << 20


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES_MAX) -> DataFrame:
    """Broadcast ``df`` when its size, measured, is at most ``limit`` bytes;
    otherwise leave the join to a shuffle."""
    size = df.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*"))) + 16), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def _ids_frame(t: Table, ids) -> DataFrame:
    if isinstance(ids, DataFrame):
        return small_side(ids.select(F.col(RID).cast("long").alias(RID)).distinct())
    ids = sorted({int(i) for i in ids})
    return small_side(t.df.sparkSession.createDataFrame([(i,) for i in ids], f"{RID} long"))


def _require_rows(t: Table, ids: DataFrame) -> None:
    """Every id is a row of the table.  The table's ids are looked up among the
    given ones (a semi join that a broadcast can serve), never the other way round."""
    present = t.df.select(RID).join(ids.select(RID), RID, "left_semi").distinct()
    if present.count() != ids.count():
        lost = ids.select(RID).join(present, RID, "left_anti").first()
        raise ValueError(f"no row has id {lost[RID]}")


def drop_rows(t: Table, ids, strict: bool = True) -> Table:
    """Remove rows by id (left-anti join); ``strict`` rejects ids not present."""
    frame = _ids_frame(t, ids)
    if strict:
        _require_rows(t, frame)
    return t.with_df(t.df.join(frame, RID, "left_anti"))


def coerce_cell(value, dt: T.DataType):
    """Raw edit text -> a value of the column's type; '' or null -> null,
    unparseable numbers and dates -> null."""
    v = F.when(value != "", value)
    if is_numeric_type(dt):
        return to_num(v, T.StringType())
    if is_datetime_type(dt):
        return to_ts(v, T.StringType())
    if is_string_type(dt):
        return v
    return v.try_cast(dt)


def apply_patches(t: Table, patches: DataFrame, strict: bool = True) -> Table:
    """Apply ``(_rid, column, value[, seq])`` edits; the highest ``seq`` wins
    per cell.  Patches are pivoted to one row per ``_rid`` (struct values, so a
    patch to null differs from no patch) and left-joined on the row id."""
    if "seq" not in patches.columns:
        patches = patches.withColumn("seq", F.lit(0).cast("long"))
    unknown = patches.where(~F.col("column").isin(t.columns)).select("column").distinct().limit(5).collect()
    if unknown:
        raise KeyError(f"unknown columns in patches: {sorted(str(r[0]) for r in unknown)}")
    names = [r[0] for r in patches.select("column").distinct().collect()]  # columns of the table
    names = [c for c in t.columns if c in names]
    if not names:
        return t
    piv = patches.groupBy(F.col(RID).cast("long").alias(RID)).agg(*[
        F.max(F.when(F.col("column") == c, F.struct(F.col("seq"), F.col("value").alias("v"))))
        .alias(f"__sj_p{i}") for i, c in enumerate(names)])
    piv = small_side(piv)  # usually a handful of edited rows: broadcast, no shuffle of the table
    if strict:
        _require_rows(t, piv)
    joined = t.df.join(piv, RID, "left")
    out = []
    for c in t.df.columns:
        if c in names:
            i = names.index(c)
            dt = t.dtype(c)
            p = F.col(f"__sj_p{i}")
            new = coerce_cell(p.getField("v"), dt)
            old = col(c).cast("double") if is_integral_type(dt) else col(c)
            out.append(F.when(p.isNotNull(), new).otherwise(old).alias(c))
        else:
            out.append(col(c))
    return t.with_df(joined.select(*out))


def set_header_row(t: Table, row: int) -> Table:
    """Promote one row's values (as text) to column names, drop it, retype."""
    from scrubjay.sources.files import reinfer_types
    picked = t.df.where(F.col(RID) == int(row)).select(
        *[to_str(col(c), t.dtype(c)).alias(c) for c in t.columns]).limit(2).collect()
    if len(picked) != 1:
        raise ValueError(f"no row has id {row}")
    names = header_names(["nan" if picked[0][c] is None else str(picked[0][c]) for c in t.columns])
    mapping = dict(zip(t.columns, names))
    rest = t.df.where(F.col(RID) != int(row))
    renamed = rest.select(*[col(c).alias(mapping[c]) if c in mapping else col(c) for c in t.df.columns])
    retyped = reinfer_types(renamed, allow_bool=False)
    return t.with_df(retyped, order=())


def header_names(values: list[str]) -> list[str]:
    """Column names from a row: a repeated name gets the next free ``_n``; reserved names are refused."""
    names: list[str] = []
    taken = set(values)
    for v in values:
        name, n = Table.allow(v), 0
        while name in names or (n and name in taken):
            n += 1
            name = f"{v}_{n}"
        names.append(name)
    return names
