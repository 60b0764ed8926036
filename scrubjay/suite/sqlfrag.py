"""DuckDB spellings of the library's column helpers, for oracle SQL."""

from __future__ import annotations

from scrubjay.functions.dates import PARSE_FORMATS
from scrubjay.functions.exprs import NUMBER_PATTERN

_WS = r"[\s\p{Z}\x{0B}\x{85}]"


def num(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '{NUMBER_PATTERN}') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def ts(x: str) -> str:
    fmts = ", ".join(f"'{p}'" for _, p in PARSE_FORMATS)
    return f"try_strptime({x}, [{fmts}])"


def title(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN NULL ELSE coalesce(list_aggregate(list_transform("
            rf"regexp_extract_all(lower({x}), '\p{{L}}+|[^\p{{L}}]+'), lambda s: upper(s[1]) || s[2:]), "
            f"'string_agg', ''), '') END)")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def cased(x: str) -> str:
    return f"(lower({x}) <> upper({x}))"


def r4(x: str) -> str:
    return f"round({x}, 4)"
