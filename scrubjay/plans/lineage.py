"""Which step reads and writes which column, and statistics remembered by it.

A recipe's tables carry a ``Lineage``: a version for every column, one for the
set of rows and one for their order.  A step gives new versions to what it
writes, made of the step itself and the versions of what it reads; all else
keeps its version.  Statistics are remembered under the versions they depend
on, so a replay (undo, reset and redo) computes those alone whose columns or
rows another history has made.  Versions are made from the steps' parameters,
never from the data; a frame among the parameters makes a version that is
never met again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field, replace

ROWS, ORDER = "rows", "order"


@dataclass(frozen=True)
class Lineage:
    columns: dict
    rows: str = ROWS
    order: str = ORDER
    memo: dict = field(default_factory=dict, compare=False)
    #: names of the statistics computed, in order, over all tables of the recipe
    computed: list = field(default_factory=list, compare=False)

    @staticmethod
    def of(columns) -> "Lineage":
        return Lineage({c: f"source:{c}" for c in columns})

    def recall(self, name, columns, compute, ordered: bool = False):
        """``compute()``, or what it gave for the same versions of these columns and the rows."""
        key = _mix(name, self.rows, self.order if ordered else "", *[(c, self.columns[c]) for c in columns])
        if key not in self.memo:
            self.memo[key] = compute()
            self.computed.append(name)
        return self.memo[key]

    def after(self, kind: str, column, params: dict, before: list, now: list) -> "Lineage":
        """The lineage of the step's result, whose columns are ``now``."""
        reads, writes, rows, order = effects(kind, column, params, before)
        seen = [(c, self.columns[c]) for c in reads if c in self.columns]
        made = _mix(kind, column, _params(params), self.rows, self.order if kind == "fill_missing" else "", *seen)
        known = dict(self.columns)
        if kind == "rename_column" and column in known:
            known[params.get("new_name")] = known.pop(column)
        columns = {c: _mix(c, made, known.get(c)) if c in writes or c not in known else known[c] for c in now}
        return replace(self, columns=columns, rows=_mix("rows", made) if rows else self.rows,
                       order=_mix(self.order, made) if order else self.order)


# The steps that look at one column and write it.
_ONE_COLUMN = {"convert_type", "standardize_case", "trim_whitespace", "standardize_date", "fix_typos", "replace_value", "edit_cell"}


def effects(kind: str, column, params: dict, columns: list) -> tuple:
    """(columns read, columns written, whether rows go, whether the order changes) of a step over these columns.

    New columns are written whatever is said here; a step not known by name
    reads and writes everything."""
    one = [column] if column else list(columns)
    if kind in ("drop_column", "rename_column"):  # a dropped column may have been a sort key
        return [], [], False, kind == "drop_column"
    if kind in _ONE_COLUMN:
        return [column], [column], False, False
    if kind == "split_datetime":
        return [column], [f"{column}_{part}" for part in params.get("components") or ["year", "month"]], False, False
    if kind == "fill_missing":  # directional fills follow the sort keys' values
        return list(columns) if params.get("method") in ("ffill", "bfill") else one, one, False, False
    if kind == "handle_outliers":
        goes = params.get("method", "cap") in ("remove", "zscore")
        return [column], [] if goes else [column], goes, False
    if kind == "filter_rows":
        return [column], [], True, False
    if kind == "drop_missing_rows":
        return one, [], True, False
    if kind in ("drop_row", "drop_rows"):
        return [], [], True, False
    if kind == "remove_duplicates":
        return list(columns), [], True, False
    if kind == "sort_values":
        return one if column else [], [], False, True
    return list(columns), list(columns), True, True


def _params(params: dict) -> str:
    return json.dumps(params, sort_keys=True, default=lambda x: uuid.uuid4().hex)


def _mix(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, default=str).encode()).hexdigest()
