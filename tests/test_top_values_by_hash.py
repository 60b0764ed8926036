"""Top values found by hash counts equal those of a plain count."""

import pytest
from pyspark.sql import functions as F

from scrubjay.operators.profile import top_values, top_values_by_hash
from scrubjay.plans.table import RID, Table


def _table(spark, n=4000):
    rows = [(i, f"unique text {(i * 7919) % n:05d}", "hot" if i % 3 == 0 else f"v{i // 2}", f"pair{i // 2:05d}", ["a", "b", None][i % 3], None, i % 2 == 0)
            for i in range(n)]
    return Table(spark.createDataFrame(rows, f"{RID} long, uniq string, hot string, twice string, few string, none string, flag boolean").repartition(6))


@pytest.mark.parametrize("k", [1, 5, 20])
def test_equal_to_a_plain_count(spark, k):
    t = _table(spark)
    want = sorted(map(tuple, top_values(t, k=k).collect()))
    assert sorted(map(tuple, top_values_by_hash(t, k=k).collect())) == want
    assert top_values_by_hash(Table(t.df.limit(0)), k=k).count() == 0
    assert top_values_by_hash(t, ["none"], k).count() == 0


@pytest.mark.parametrize("slots", [1, 3, 64, 1000])
def test_values_that_share_a_hash(spark, slots):
    t = _table(spark, 1200)
    want = sorted(map(tuple, top_values(t).collect()))
    assert sorted(map(tuple, top_values_by_hash(t, hash_of=lambda c: F.pmod(F.xxhash64(c), F.lit(slots))).collect())) == want


def test_a_unique_text_is_not_shuffled(spark):
    """Of a unique column no exchange carries the text but that of the k rows a task found."""
    plan = top_values_by_hash(_table(spark), ["uniq"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in plan and "Join" not in plan
