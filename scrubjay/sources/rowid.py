"""Row ids and positions without an unpartitioned window over rows.

* Load order of a Parquet scan: a row is known by its file and its index in
  the file (``_metadata.row_index``), whatever splits a scan is cut into, so
  the files' row counts alone place it.
* Load order of other files: the rows are staged once as a table that carries
  each row's split and place; counting and numbering read that table.
* Any other order: range-partition and sort by the keys, stage the numbered
  result (range bounds are sampled, a recompute could move rows), and number
  from it. With a unique ``key`` only the key and the order columns are staged.

Offsets are one row per file, split or partition. A row without an offset is an
error, never dropped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.session import staged

# Offsets are two numbers a group (files are known by a 64-bit hash of their
# path): 32 MB at most are broadcast, beyond that the join shuffles.
BROADCAST_OFFSETS_MAX = 2_000_000


def _number(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``df``, whose rows know their group (``__sj_rg``) and place (``__sj_ri``), numbered group by group."""
    counted = df.groupBy("__sj_rg").agg(F.count("*").alias("__sj_n"), F.min("__sj_ri").alias("__sj_first"), F.min(order).alias("__sj_o"))
    before = Window.orderBy("__sj_o").rowsBetween(Window.unboundedPreceding, -1)  # one row per file, split or partition
    shift = F.coalesce(F.sum("__sj_n").over(before), F.lit(0)) - F.col("__sj_first")
    offsets = staged(counted.select("__sj_rg", "__sj_o", shift.alias("__sj_off")), "offsets")
    totals = offsets.agg(F.count("*").alias("n"), F.countDistinct("__sj_o").alias("d")).first()
    if totals["n"] != totals["d"]:
        raise RuntimeError("two files share a path hash: row ids would collide")
    offsets = offsets.drop("__sj_o")
    joined = df.join(F.broadcast(offsets) if totals["n"] <= BROADCAST_OFFSETS_MAX else offsets, "__sj_rg", "left")
    lost = F.raise_error(F.lit("a row's file or partition was not there when rows were counted")).cast("long")
    number = F.when(F.col("__sj_off").isNull(), lost).otherwise(F.col("__sj_off") + F.col("__sj_ri"))
    return joined.withColumn(name, number.cast("long")).select(
        *[F.col("`" + c.replace("`", "``") + "`") for c in df.columns if not c.startswith("__sj_r")], name)


def _place() -> Column:
    """A row's index in its partition."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


# What Spark says of a metadata field that a source does not have.
_NO_FIELD = ("FIELD_NOT_FOUND", "UNRESOLVED_COLUMN", "UNRESOLVED_FIELD")


def has_metadata(df: DataFrame, field: str) -> bool:
    """Whether ``df`` is a file read whose rows know ``_metadata.<field>``."""
    try:
        df.select(F.col(f"_metadata.{field}"))
    except AnalysisException as e:
        if not (e.getCondition() or "").startswith(_NO_FIELD):
            raise
        return False
    return True


def with_load_order_id(df: DataFrame, name: str = "_rid", reshape=None) -> DataFrame:
    """Ids 0..n-1 in file order (by path, then place in the file) for a frame straight from a file read.

    ``reshape`` may turn a row into several or none (an explode, in order)
    before rows are numbered; it must keep the columns that begin with ``__sj_r``."""
    path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    if reshape is None and has_metadata(df, "row_index"):  # only Parquet knows a row's index in its file
        tagged = df.select("*", F.xxhash64(path).alias("__sj_rg"), path.alias("__sj_rp"), F.col("_metadata.row_index").alias("__sj_ri"))
        return _number(tagged, F.col("__sj_rp"), name)
    if not has_metadata(df, "file_path"):  # not read from files
        return with_row_id(df if reshape is None else reshape(df), name=name)
    tagged = df.select("*", F.xxhash64(path, start).alias("__sj_rg"), F.struct(path, start).alias("__sj_rp"))
    tagged = (tagged if reshape is None else reshape(tagged)).withColumn("__sj_ri", _place())
    return _number(staged(tagged, "loaded"), F.col("__sj_rp"), name)


def with_row_id(df: DataFrame, order_by=None, name: str = "_rid", partitions: int | None = None,
                key: str | None = None, columns=()) -> DataFrame:
    """Attach a 0-based contiguous id following ``order_by`` (Columns).

    Without ``order_by`` the current partition order is numbered. The order
    must be total for the result to be deterministic. ``key`` names a unique,
    non-null column and ``columns`` those that ``order_by`` reads: then only
    these are staged, and the numbers are joined back by the key.
    """
    if order_by and key:
        return df.join(positions(df, order_by, key, columns, name, partitions), key)
    return _number(_staged_order(df, order_by, partitions), F.col("__sj_rg"), name)


def positions(df: DataFrame, order_by, key: str, columns=(), name: str = "_pos", partitions: int | None = None) -> DataFrame:
    """(key, name): the place of every row in the order, without the other columns."""
    thin = df.select(*["`" + c.replace("`", "``") + "`" for c in dict.fromkeys([key, *columns])])
    ordered = _staged_order(thin, order_by, partitions, keep=key)
    return _number(ordered, F.col("__sj_rg"), name)


def _staged_order(df: DataFrame, order_by, partitions: int | None, keep: str | None = None) -> DataFrame:
    if order_by:
        n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
    if keep:
        df = df.select(keep)
    return _staged_places(df, "__sj_rg", "__sj_ri")


def _staged_places(df: DataFrame, group: str, place: str) -> DataFrame:
    return staged(df.withColumn(group, F.spark_partition_id().cast("long")).withColumn(place, _place()), "positions")


def staged_by(df: DataFrame, order_by, partitions: int, group: str, place: str) -> DataFrame:
    """Whole rows staged in the order: ``group`` numbers the ranges in order,
    ``place`` the rows of a range.  An order that ends with a unique key splits
    a hot value among ranges."""
    return _staged_places(df.repartitionByRange(partitions, *order_by).sortWithinPartitions(*order_by), group, place)
