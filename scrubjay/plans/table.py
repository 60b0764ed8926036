"""``Table``: a DataFrame with a stable row id and a notion of current row order.

Row identity is the ``_rid`` column (a BIGINT, unique, never renumbered by a
step).  Current order is a tuple of sort keys applied before ``_rid``; it is
metadata only, so steps never physically sort the data.  Order-sensitive
operators (ffill/bfill, page slices, sort positions) read it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubjay.functions.exprs import col
from scrubjay.plans.lineage import Lineage

RID = "_rid"
INTERNAL_PREFIX = "__sj_"


def is_internal(name: str) -> bool:
    return name == RID or name.startswith(INTERNAL_PREFIX)


@dataclass(frozen=True)
class Table:
    df: DataFrame
    order: tuple = field(default=())  # ((column, ascending), ...), most significant first
    lineage: Lineage | None = field(default=None, compare=False)  # set by a recipe; another frame has none

    # -- construction -------------------------------------------------------
    @staticmethod
    def allow(name: str) -> str:
        """``name`` if a data column may have it; the row id's and internal names are refused."""
        if is_internal(name):
            raise ValueError(f"column name {name!r} is reserved")
        return name

    @staticmethod
    def from_df(df: DataFrame, rid: str | None = None) -> "Table":
        """Wrap a frame; ``rid`` names an existing unique integer key to use as
        the row id, otherwise ids are assigned in load order."""
        if rid is not None:
            return Table(df.withColumnRenamed(rid, RID).withColumn(RID, F.col(RID).cast("long")))
        if RID in df.columns:
            return Table(df)
        from scrubjay.sources.rowid import with_row_id
        return Table(with_row_id(df))

    def with_df(self, df: DataFrame, order: tuple | None = None) -> "Table":
        return replace(self, df=df, order=self.order if order is None else order, lineage=None)

    def recall(self, name, columns, compute, ordered: bool = False):
        """A statistic of these columns, remembered where the table belongs to a recipe."""
        return compute() if self.lineage is None else self.lineage.recall(name, columns, compute, ordered)

    # -- schema ---------------------------------------------------------------
    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not is_internal(c)]

    def dtype(self, name: str) -> T.DataType:
        self.require(name)
        return self.df.schema[name].dataType

    def require(self, name: str) -> None:
        if name is None or name not in self.columns:
            raise KeyError(f'column "{name}" not found')

    # -- order ------------------------------------------------------------------
    def sort_exprs(self) -> list[Column]:
        keys = [col(c).asc_nulls_last() if asc else col(c).desc_nulls_last()
                for c, asc in self.order if c in self.df.columns]
        return keys + [F.col(RID).asc()]

    def ordered(self) -> DataFrame:
        """The data in current order (a global sort: only for small outputs)."""
        return self.df.orderBy(*self.sort_exprs())

    def positions(self, name: str = "_pos") -> DataFrame:
        """Attach the 0-based position of each row in the current order."""
        return self.df.join(self.position_index(name), RID)

    def position_index(self, name: str = "_pos") -> DataFrame:
        """(row id, position): only the row id and the sort keys are moved."""
        from scrubjay.sources.rowid import positions
        keys = [c for c, _ in self.order if c in self.df.columns]
        return positions(self.df, self.sort_exprs(), RID, keys, name)

    def data(self) -> DataFrame:
        """User-visible columns (no row id)."""
        return self.df.select(*[col(c) for c in self.columns])
