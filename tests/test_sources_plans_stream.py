"""Sources (files written into a fresh temporary folder), physical-plan
checks, and the streaming path."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from scrubjay.operators.fills import directional_fill
from scrubjay.operators.steps import apply_step
from scrubjay.plans.recipe import Step
from scrubjay.plans.table import RID, Table
from scrubjay.sources.files import read_records_json, read_table_csv, write_csv
from scrubjay.sources.rowid import with_load_order_id, with_row_id
from scrubjay.streaming.stream import apply_to_stream, clean_stream
from scrubjay.suite.base import fixture, loaded
from tests.conftest import SF_SMALL

QUOTED_CSV = 'a,b,c,d\n,NA,"q,""r""",true\n2,"multi\nline",x,false\n3,NA,plain,true\n'


def test_quoted_csv_nulls_and_inference(spark, tmp_dir):
    p = os.path.join(tmp_dir, "q.csv")
    with open(p, "w") as f:
        f.write(QUOTED_CSV)
    t = read_table_csv(spark, p)
    rows = t.df.orderBy(RID).collect()
    assert [r[RID] for r in rows] == [0, 1, 2]
    assert dict(t.df.dtypes)["a"] == "bigint" and dict(t.df.dtypes)["d"] == "boolean"
    assert rows[0]["a"] is None and rows[0]["b"] is None
    assert rows[0]["c"] == 'q,"r"' and rows[1]["b"] == "multi\nline"


def test_nested_and_wrapped_json(spark, tmp_dir):
    p1 = os.path.join(tmp_dir, "n.json")
    with open(p1, "w") as f:
        json.dump([{"a": {"b": 1, "c": {"d": 2}}, "e": [1, 2]}, {"a": {"b": 3}}], f)
    t = read_records_json(spark, p1)
    assert sorted(t.columns) == ["a.b", "a.c.d", "e"]
    rows = t.df.orderBy(RID).collect()
    assert rows[0]["a.c.d"] == 2 and rows[1]["a.c.d"] is None and rows[0]["e"] == [1, 2]
    p2 = os.path.join(tmp_dir, "w.json")
    with open(p2, "w") as f:
        json.dump({"data": [{"a": {"b": 1}, "e": [1]}, {"a": {"b": 2}}]}, f)
    assert read_records_json(spark, p2).df.count() == 2


def test_csv_roundtrip_keeps_order(spark, tmp_dir):
    t = apply_step(fixture(spark, SF_SMALL, "ev_dirty"), "sort_values", "value", {"direction": "desc"})
    out = os.path.join(tmp_dir, "out")
    write_csv(t, out)
    back = read_table_csv(spark, out)
    got = [r["value"] for r in back.df.orderBy(RID).limit(20).collect()]
    want = [r["value"] for r in t.ordered().limit(20).collect()]
    assert got == want


def test_row_ids_load_order_and_sorted(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ids = with_load_order_id(ev).select(RID, "event_id").collect()
    assert all(r[RID] == r["event_id"] for r in ids)  # file order is event_id order
    ranked = with_row_id(ev.repartition(5), order_by=[F.col("value").desc(), F.col("event_id")], name="p")
    got = [r["event_id"] for r in ranked.orderBy("p").collect()]
    want = [r["event_id"] for r in ev.orderBy(F.col("value").desc(), "event_id").collect()]
    assert got == want
    assert sorted(r["p"] for r in ranked.select("p").collect()) == list(range(len(want)))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_single_partition_exchange_over_the_data(spark):
    t = fixture(spark, SF_SMALL, "ev_dirty")
    assert "SinglePartition" not in _plan(apply_step(t, "remove_duplicates").df)
    # the window over one row per block runs when the step is appended
    assert "SinglePartition" not in _plan(directional_fill(t, ["value_sparse"]).df)


def test_filters_push_down_to_the_scan(spark):
    t = loaded(spark, SF_SMALL, "events")
    f = apply_step(t, "filter_rows", "value", {"condition": "less_than", "value": "10"})
    plan = _plan(f.df.select(RID, "value"))
    assert "PushedFilters: [IsNotNull(value), LessThan(value,10.0)]" in plan
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_streaming_row_local_recipe(spark, tmp_dir):
    src, sink, ck = (os.path.join(tmp_dir, d) for d in ("src", "sink", "ck"))
    ev = fixture(spark, SF_SMALL, "ev_dirty").df.select("type_pad", "num_text", "date_text")
    ev.write.parquet(src)
    steps = [Step("trim_whitespace", "type_pad"), Step("standardize_case", "type_pad", {"case": "upper"}),
             Step("convert_type", "num_text", {"target": "numeric"}),
             Step("standardize_date", "date_text", {"format": "%Y-%m-%d"}),
             Step("split_datetime", "date_text", {"components": ["year", "month"]})]
    q = clean_stream(spark, src, ev.schema, steps, sink, ck)
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == ev.count()
    static = apply_to_stream(ev, steps)
    assert out.exceptAll(static).count() == 0
    with pytest.raises(ValueError):
        apply_to_stream(ev, [Step("fill_missing", "num_text", {"method": "median"})])


def test_ffill_plan_has_no_sort_aggregate_over_data(spark):
    t = fixture(spark, SF_SMALL, "ev_dirty")
    plan = _plan(directional_fill(t, ["value_sparse"]).df)
    assert "SortAggregate" not in plan
    assert "Window" in plan and "hashpartitioning(__sj_blk" in plan


def test_load_order_ids_across_split_and_packed_files(spark, tmp_dir):
    """Files of very different sizes: big ones split, small ones packed into
    one partition. Ids must follow (file name, row within file)."""
    import glob

    import pyarrow.parquet as pq
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    out = os.path.join(tmp_dir, "multi")
    (ev.withColumn("g", F.when(F.col("event_id") < 50, F.col("event_id") % 5).otherwise(5))
       .repartition("g").sortWithinPartitions("event_id").drop("g").write.parquet(out))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = spark.read.parquet(out)
        assert df.rdd.getNumPartitions() > 1
        got = [r["event_id"] for r in with_load_order_id(df).orderBy(RID).select("event_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = []
    for f in sorted(glob.glob(os.path.join(out, "*.parquet"))):
        want += pq.read_table(f, columns=["event_id"]).column("event_id").to_pylist()
    assert got == want


def test_csv_sink_format(spark, tmp_dir):
    import glob
    rows = [(0, "a,b", None), (1, 'say "hi"', 2.5)]
    t = Table.from_df(spark.createDataFrame(rows, "id long, s string, x double"), rid="id")
    out = os.path.join(tmp_dir, "sink")
    write_csv(t, out)
    text = "".join(open(f).read() for f in sorted(glob.glob(os.path.join(out, "part-*"))))
    lines = [ln for ln in text.splitlines() if ln]
    assert lines.count("s,x") >= 1 and "_rid" not in text  # header, no row id
    assert '"a,b",' in lines and '"say ""hi""",2.5' in lines  # null -> empty field, doubled quotes
