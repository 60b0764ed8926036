"""scrubjay: data-quality profiling and wrangling as Spark DataFrame operators.

Layers
------
- ``scrubjay.sources``   readers, null normalisation, row ids, type inference, CSV sink
- ``scrubjay.functions`` column-expression helpers (coercion, casing, dates, quantiles)
- ``scrubjay.operators`` profile, quality findings, cleaning steps, chart data
- ``scrubjay.plans``     ``Table`` (frame + row order) and ``Recipe`` (replayable steps)
- ``scrubjay.streaming`` row-local recipes over streaming DataFrames
"""

from scrubjay.plans.table import RID, Table
from scrubjay.plans.recipe import Recipe, Step

__all__ = ["RID", "Table", "Recipe", "Step"]
