"""Hot keys: one value holding a third of the rows must not change results
(or land the work in one group)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrubjay.functions.quantiles import exact_quantiles
from scrubjay.operators import quality as Q
from scrubjay.operators.profile import duplicate_count, top_values
from scrubjay.operators.steps import apply_step, mode_values
from scrubjay.plans.table import RID, Table


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = np.random.default_rng(9)
    n = 6000
    hot = rnd.random(n) < 1 / 3
    vals = np.where(hot, 42.0, rnd.lognormal(3, 1, n))
    cats = np.where(hot, "hot", np.array(["a", "b", "c", "d"])[rnd.integers(0, 4, n)])
    rows = [(i, float(v), str(c)) for i, (v, c) in enumerate(zip(vals, cats))]
    df = spark.createDataFrame(rows, "id long, v double, c string").repartition(6)
    return Table.from_df(df, rid="id"), pd.DataFrame(rows, columns=["id", "v", "c"])


def test_quantiles_with_hot_value(spark, skewed):
    t, pdf = skewed
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = exact_quantiles(t.df, [("v", F.col("v"), None)], probs)["v"]
    assert got == pytest.approx(list(np.quantile(pdf["v"], probs)), rel=1e-12)


def test_mode_top_values_and_dups_with_hot_key(spark, skewed):
    t, pdf = skewed
    assert mode_values(t, ["c", "v"]) == {"c": "hot", "v": "42.0"}
    top = top_values(t, ["c"], k=2).orderBy("rank").collect()
    assert top[0]["value"] == "hot" and top[0]["count"] == int((pdf["c"] == "hot").sum())
    dups = duplicate_count(Table(t.df.select(RID, "c"))).first()["duplicates"]
    assert dups == len(pdf) - pdf["c"].nunique()
    kept = apply_step(Table(t.df.select(RID, "c")), "remove_duplicates").df.count()
    assert kept == pdf["c"].nunique()


def test_findings_with_hot_value(spark, skewed):
    t, pdf = skewed
    out = {r["column"]: r for r in Q.outliers(t).collect()}
    q1, q3 = np.quantile(pdf["v"], [0.25, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert out["v"]["count"] == int(((pdf["v"] < lo) | (pdf["v"] > hi)).sum())
