"""CSV files are split among tasks unless a field may break a line."""

import csv
import os

import pytest

from scrubjay.plans.table import RID
from scrubjay.sources.files import has_line_breaks, read_table_csv


def _write(folder, name, rows, end="\n"):
    with open(os.path.join(folder, name), "w", newline="") as f:
        csv.writer(f, lineterminator=end).writerows([["id", "word"], *rows])


CASES = [("plain", [(1, "a"), (2, "b")], "\n", False), ("doubled", [(1, 'say ""x"" now'), (2, '"')], "\n", False),
         ("windows", [(1, "a"), (2, "b,c")], "\r\n", False), ("broken", [(1, "a\nb"), (2, "c")], "\n", True),
         ("quote and break", [(1, '"\n"'), (2, "c")], "\n", True), ("lone return", [(1, "a\rb"), (2, "c")], "\n", True)]


@pytest.mark.parametrize("name,rows,end,want", CASES, ids=[c[0] for c in CASES])
def test_line_breaks_are_found(spark, tmp_dir, name, rows, end, want):
    _write(tmp_dir, "t.csv", rows, end)
    assert has_line_breaks(spark, tmp_dir) is want
    got = read_table_csv(spark, tmp_dir, infer=False).df.orderBy(RID).collect()
    assert [(r["id"], r["word"].replace("\r", "\n")) for r in got] == [(str(i), w.replace("\r", "\n")) for i, w in rows]


def test_a_large_file_is_split(spark, tmp_dir):
    _write(tmp_dir, "big.csv", [(i, f"word, {i}") for i in range(20_000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        t = read_table_csv(spark, tmp_dir)
        assert len([f for f in os.listdir(tmp_dir) if f.endswith(".csv")]) == 1 and t.df.rdd.getNumPartitions() > 1
        got = [(r[RID], r["id"], r["word"]) for r in t.df.orderBy(RID).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, i, f"word, {i}") for i in range(20_000)]
