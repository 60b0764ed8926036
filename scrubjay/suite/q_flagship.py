"""Flagship: dirty events -> profile -> findings -> recommended recipe -> chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubjay.functions.exprs import round_half_away

from scrubjay.operators import quality
from scrubjay.operators.charts import bar_mean
from scrubjay.plans.recipe import Recipe, Step
from scrubjay.plans.table import RID
from scrubjay.suite.base import fixture, query

FLAGSHIP_SQL = """
WITH med AS (SELECT quantile_cont(value, 0.5) AS m FROM ev_dirty),
f AS (SELECT rid, event_type, coalesce(value, (SELECT m FROM med)) AS value FROM ev_dirty),
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f),
c AS (SELECT event_type,
        CASE WHEN value IS NULL THEN NULL
             ELSE least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END AS value
      FROM f, q)
SELECT event_type AS category, round(avg(value), 4) AS value
FROM c WHERE event_type IS NOT NULL
GROUP BY event_type ORDER BY value DESC, category LIMIT 15
"""


@query("flagship_clean_chart", sql=FLAGSHIP_SQL, fixtures=("ev_dirty",))
def flagship_clean_chart(spark, sf):
    t = fixture(spark, sf, "ev_dirty")
    one = t.with_df(t.df.select(RID, "value"))  # only the column that gets cleaned is profiled
    sc = quality.scan(one, text=False)  # profile: nulls, moments
    fill = {r[0]: r[4] for r in quality.missing_rows(one, sc)}
    outl = {r[0]: r[6] for r in quality.outliers_rows(one, sc)}
    r = Recipe(t)
    r = r.append(Step("fill_missing", "value", {"method": fill.get("value", "median")}))
    r = r.append(Step("handle_outliers", "value", {"method": outl.get("value", "cap")}))
    chart = bar_mean(r.result, "event_type", "value")
    return chart.select("category", round_half_away(F.col("value"), 4).alias("value"))

