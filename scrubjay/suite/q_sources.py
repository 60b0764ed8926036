"""Source and sink queries (S1-S7): CSV and JSON round trips through a
scratch folder under the session's checkpoint folder, null normalisation,
row ids and type re-inference."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from scrubjay.plans.table import RID
from scrubjay.sources.files import normalise_nulls, read_records_json, read_table_csv, reinfer_types, write_csv
from scrubjay.sources.rowid import with_load_order_id, with_row_id
from scrubjay.suite.base import fixture_df, loaded, query, scratch_dir, table

EV = ("ev_dirty",)


@query("src_csv_roundtrip",
       "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, value, props FROM events")
def src_csv_roundtrip(spark, sf):
    path = os.path.join(scratch_dir(spark), "events_csv")
    write_csv(loaded(spark, sf, "events"), path)
    back = read_table_csv(spark, path)
    return back.df.select("event_id", "ts", "user_id", "event_type", "value", "props")


@query("src_json_records",
       'SELECT o_orderkey AS "o.key", o_custkey AS "o.cust", o_orderstatus AS status, o_totalprice AS price FROM orders')
def src_json_records(spark, sf):
    path = os.path.join(scratch_dir(spark), "orders_json")
    rec = F.struct(F.struct(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust")).alias("o"),
                   F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    # each line wraps at most 8 records in a "data" list (bounded groups)
    (table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 8).alias("g"))
     .agg(F.collect_list(rec).alias("data")).select("data").write.json(path))
    t = read_records_json(spark, path, multiline=False)
    return t.df.select("`o.key`", "`o.cust`", "status", "price")


@query("src_flatten",
       'SELECT o_orderkey AS "a.b", CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_custkey END AS "a.c.d", '
       "concat(o_orderkey, ',', o_custkey) AS e FROM orders")
def src_flatten(spark, sf):
    path = os.path.join(scratch_dir(spark), "orders_nested")
    o = table(spark, sf, "orders")
    nested = o.select(
        F.struct(F.col("o_orderkey").alias("b"),
                 F.when(F.col("o_orderkey") % 2 != 0, F.struct(F.col("o_custkey").alias("d"))).alias("c")).alias("a"),
        F.array("o_orderkey", "o_custkey").alias("e"))
    nested.write.json(path)
    t = read_records_json(spark, path, multiline=False)
    return t.df.select("`a.b`", "`a.c.d`", F.array_join(F.col("e").cast("array<string>"), ",").alias("e"))


# Fixed values, written out apart from the engine's own list: what pandas ``read_csv`` takes for null.
_TOKENS = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', "
           "'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'")


@query("src_nulls",
       f"SELECT rid, CASE WHEN num_text IN ({_TOKENS}) THEN NULL ELSE num_text END AS num_text, "
       "CASE WHEN rid % 5 = 0 THEN NULL ELSE value END AS value_nan FROM ev_dirty", EV)
def src_nulls(spark, sf):
    ev = fixture_df(spark, sf, "ev_dirty")
    raw = spark.sql("SELECT rid, num_text, CASE WHEN rid % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value_nan "
                    "FROM {ev}", ev=ev)
    return normalise_nulls(raw)


@query("src_row_id",
       "SELECT rid, row_number() OVER (ORDER BY user_id, ts DESC, rid) - 1 AS pos FROM ev_dirty", EV)
def src_row_id(spark, sf):
    ev = fixture_df(spark, sf, "ev_dirty")
    keyed = with_row_id(ev, order_by=[F.col("user_id").asc(), F.col("ts").desc(), F.col("rid").asc()], name="pos",
                        key="rid", columns=["user_id", "ts"])
    return keyed.select("rid", "pos")


@query("src_reinfer",
       "SELECT rid, CAST(c0 AS BIGINT) AS c0, c1, CAST(c2 AS DOUBLE) AS c2 FROM raw_header WHERE rid <> 0",
       ("raw_header",))
def src_reinfer(spark, sf):
    raw = fixture_df(spark, sf, "raw_header").where(F.col("rid") != 0)
    return reinfer_types(raw.withColumnRenamed("rid", RID)).withColumnRenamed(RID, "rid")


@query("src_load_order_id",
       "SELECT row_number() OVER () - 1 AS id, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem")
def src_load_order_id(spark, sf):
    return with_load_order_id(table(spark, sf, "lineitem"), "id").select("id", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("src_reinfer_bigint",
       "SELECT rid, CAST(id19 AS BIGINT) AS id19, CAST(CAST(id21 AS HUGEINT) AS VARCHAR) AS id21, id45, CAST(half AS DOUBLE) AS half FROM raw_long",
       ("raw_long",))
def src_reinfer_bigint(spark, sf):
    """Integers beyond 64 bits stay exact: decimals up to 38 digits, text beyond."""
    df = reinfer_types(fixture_df(spark, sf, "raw_long").withColumnRenamed("rid", RID)).withColumnRenamed(RID, "rid")
    return df.withColumn("id21", F.col("id21").cast("string"))


@query("src_json_order",
       'SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS rid, o_orderkey AS "o.key", o_orderstatus AS status FROM orders')
def src_json_order(spark, sf):
    """Records of several files of unequal size, numbered in path order: a few plain lines, then lists under ``data``."""
    folder = scratch_dir(spark)
    o = table(spark, sf, "orders")
    rec = F.struct(F.struct(F.col("o_orderkey").alias("key")).alias("o"), F.col("o_orderstatus").alias("status"))
    lists = o.groupBy(F.floor(F.col("o_orderkey") / 8).alias("g")).agg(F.sort_array(F.collect_list(rec)).alias("data"))  # at most 8 a list
    few = F.col("g") < 5
    lists.where(few).repartitionByRange(1, "g").sortWithinPartitions("g").select("data").write.json(os.path.join(folder, "json", "a"))
    lists.where(~few).repartitionByRange(3, "g").sortWithinPartitions("g").select("data").write.json(os.path.join(folder, "json", "b"))
    t = read_records_json(spark, os.path.join(folder, "json", "*"), multiline=False)
    return t.df.select(F.col(RID).alias("rid"), "`o.key`", "status")
