"""Registry of named queries: each is a Spark callable plus (optionally) the
DuckDB SQL that must give the same rows."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubjay.plans.table import RID, Table
from scrubjay.session import scratch_path
from scrubjay.suite.fixtures import FIXTURES, TABLES, with_fixtures

QUERIES: dict = {}
_RESERVED = re.compile(r"(?<![\w\"'])column(?![\w\"'])")
ORACLE: dict = {}


def query(name: str, sql: str | None = None, fixtures: tuple = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is the
    oracle, wrapped with the named fixture CTEs."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            text = with_fixtures(sql, *fixtures) if fixtures else sql
            ORACLE[name] = _RESERVED.sub('"column"', text)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fixture_df(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FIXTURES[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> Table:
    """A dirty view as a Table whose row id is its ``rid`` column."""
    return Table.from_df(fixture_df(spark, sf_dir, name), rid="rid")


def out(t: Table, *columns: str) -> DataFrame:
    """Row id (as ``rid``) plus the named columns, or all of them."""
    cols = list(columns) or t.columns
    return t.df.select(F.col(RID).alias("rid"), *[F.col("`" + c + "`") for c in cols])


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the session's checkpoint folder (shared storage on
    a cluster), deleted when the driver ends."""
    return scratch_path(spark, "scratch")


# Unique integer keys usable as row ids (deterministic, so filters still push
# down to the scan); other tables get load-order ids.
TABLE_KEYS = {"events": "event_id", "orders": "o_orderkey", "part": "p_partkey", "documents": "doc_id",
              "customer": "c_custkey", "supplier": "s_suppkey"}


def loaded(spark: SparkSession, sf_dir: str, name: str) -> Table:
    """A driver table as a Table (the key column stays a data column)."""
    df = table(spark, sf_dir, name)
    key = TABLE_KEYS.get(name)
    if key:
        return Table(df.withColumn(RID, F.col(key).cast("long")))
    from scrubjay.sources.rowid import with_load_order_id
    return Table(with_load_order_id(df, RID))
