"""File sources and sinks (S1-S4, S6, S7).

Text sources are read with every field as a string and typed afterwards by
one aggregate over all columns, because Spark's own CSV inference differs
from the reference (dates become dates, ``NA`` stays text).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubjay.functions.exprs import (NA_TOKENS, NUMBER_PATTERN, col, is_float_type,
                                      is_string_type, strip, to_num)
from scrubjay.plans.table import RID, Table, is_internal
from scrubjay.sources.rowid import with_load_order_id


# -- S4: null normalisation -----------------------------------------------------
def normalise_nulls(df: DataFrame, tokens=NA_TOKENS, inf_to_null: bool = False) -> DataFrame:
    """NaN -> null on floating columns; NA tokens -> null on text columns."""
    token_set = list(tokens)
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if is_internal(f.name):
            out.append(c)
        elif is_float_type(f.dataType):
            v = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
            if inf_to_null:
                v = F.when(F.abs(v) != float("inf"), v)
            out.append(v.cast(f.dataType).alias(f.name))
        elif is_string_type(f.dataType):
            out.append(F.when(~c.isin(token_set), c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


# -- S7: type inference -------------------------------------------------------------
_INT_PATTERN = r"^\s*[+-]?\d+\s*$"
_WIDE_PATTERN = r"^\s*[+-]?0*\d{1,38}\s*$"
_BOOL_PATTERN = r"(?i)^\s*(true|false)\s*$"


def reinfer_types(df: DataFrame, columns=None, allow_bool: bool = True) -> DataFrame:
    """Retype text columns whose every non-null value is boolean / integer / number.

    One aggregate over all candidate columns decides; a column becomes numeric
    only when no non-null value would be lost.  Integers that do not all fit 64
    bits become decimals of 38 digits, longer ones stay text; a column is a
    double only where some value has a fraction or an exponent.
    """
    cands = [f.name for f in df.schema.fields
             if is_string_type(f.dataType) and not is_internal(f.name)
             and (columns is None or f.name in columns)]
    if not cands:
        return df
    aggs = []
    for i, name in enumerate(cands):
        c = col(name)
        aggs += [F.count(c).alias(f"n{i}"),
                 F.count(F.when(c.rlike(_BOOL_PATTERN), 1)).alias(f"b{i}"),
                 F.count(F.when(c.rlike(_INT_PATTERN), 1)).alias(f"i{i}"),
                 F.count(F.when(c.rlike(_INT_PATTERN), strip(c).try_cast("long"))).alias(f"l{i}"),
                 F.count(F.when(c.rlike(_WIDE_PATTERN), 1)).alias(f"w{i}"),
                 F.count(F.when(c.rlike(NUMBER_PATTERN), 1)).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    kinds = {}
    for i, name in enumerate(cands):
        n = row[f"n{i}"]
        if n == 0:
            continue
        if allow_bool and row[f"b{i}"] == n:
            kinds[name] = "boolean"
        elif row[f"l{i}"] == n:
            kinds[name] = "long"
        elif row[f"w{i}"] == n:
            kinds[name] = "decimal(38,0)"
        elif row[f"i{i}"] == n:
            continue
        elif row[f"d{i}"] == n:
            kinds[name] = "double"
    if not kinds:
        return df
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        k = kinds.get(f.name)
        if k == "boolean":
            out.append((F.lower(strip(c)) == "true").alias(f.name))
        elif k in ("long", "decimal(38,0)"):
            out.append(strip(c).try_cast(k).alias(f.name))
        elif k == "double":
            out.append(to_num(c, T.StringType()).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


# -- S1: CSV ------------------------------------------------------------------------
def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a CSV may hold a field over several lines: a line with an odd
    number of quotes, or a carriage return elsewhere than at a line's end.
    Lines are read by as many tasks as the files have splits."""
    line = F.regexp_replace("value", "\r$", "")
    odd = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path)
    return not lines.where((odd % 2 == 1) | line.contains("\r")).limit(1).isEmpty()


def read_table_csv(spark: SparkSession, path: str, infer: bool = True, multiline: bool | None = None) -> Table:
    """Headered CSV -> Table with load-order row ids and inferred types.

    A file is read by many tasks if no field may break a line, which one pass
    over the lines finds out (``has_line_breaks``); ``multiline`` spares that
    pass: ``False`` promises such fields away, ``True`` reads a file in one
    task.  The text is parsed once and staged (``with_load_order_id``); ids and
    types come from there."""
    if multiline is None:
        multiline = has_line_breaks(spark, path)
    raw = (spark.read.option("header", True).option("multiLine", multiline)
           .option("quote", '"').option("escape", '"')
           .option("inferSchema", False).csv(path))
    raw = with_load_order_id(raw, RID)
    df = normalise_nulls(raw)
    if infer:
        df = reinfer_types(df)
    return Table(df)


# -- S2 / S3: JSON records ---------------------------------------------------------------
def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs -> flat columns named ``a.b.c``; arrays stay as they are."""
    def walk(dt: T.StructType, path: list[str]):
        for f in dt.fields:
            p = path + [f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, p)
            else:
                ref = F.col(".".join("`" + x.replace("`", "``") + "`" for x in p))
                yield ref.alias(sep.join(p))
    return df.select(*walk(df.schema, []))


def read_records_json(spark: SparkSession, path: str, multiline: bool | None = None) -> Table:
    """JSON records with load-order row ids: JSON Lines, a JSON array of
    records, an object whose ``data`` key holds the list, or one record.  Ids
    follow the files' paths, then the records' places in their file.

    JSON Lines (``multiline=False``) are split among tasks; one document over
    several lines (``multiline=True``) is one task.  Without either, the first
    line decides: a file whose first line is a whole object is read as lines."""
    if multiline is None:
        head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
        multiline = not (head and _whole_object(head[0][0]))
    raw = spark.read.option("multiLine", multiline).option("primitivesAsString", False).json(path)
    data_t = next((f.dataType for f in raw.schema.fields if f.name == "data"), None)
    wrapped = isinstance(data_t, T.ArrayType) and isinstance(data_t.elementType, T.StructType)
    return Table(normalise_nulls(flatten_structs(with_load_order_id(raw, RID, _unwrapped if wrapped else None))))


def _unwrapped(raw: DataFrame) -> DataFrame:
    """The records of every row's ``data`` list, in their order."""
    kept = [c for c in raw.columns if is_internal(c)]
    return raw.select(*kept, F.posexplode("data").alias("__sj_at", "__sj_rec")).select(*kept, "__sj_rec.*")


def _whole_object(line: str) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


# Timestamps are written as text with microseconds.
TS_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


# -- S6: CSV sink ---------------------------------------------------------------------
def write_csv(table: Table, path: str, mode: str = "overwrite", ordered: bool = True) -> None:
    """Header, no row id, nulls as empty fields; multi-part output.

    ``ordered`` range-partitions by the current order so part files
    concatenate in row order (no single-task sort)."""
    df = table.df
    if ordered:
        df = df.repartitionByRange(*table.sort_exprs()).sortWithinPartitions(*table.sort_exprs())
    out = df.select(*[col(c) for c in table.columns])
    (out.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
        .option("nullValue", "").option("emptyValue", '""')
        .option("timestampFormat", TS_TEXT_FORMAT).option("timestampNTZFormat", TS_TEXT_FORMAT).csv(path))
