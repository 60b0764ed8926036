"""Tolerant date parsing and formatting.

Text is parsed by trying a fixed list of formats in order and keeping the
first that succeeds; month-first styles come before day-first ones, so an
ambiguous ``05/01/2024`` reads as 1 May and ``13/02/2024`` as 13 February.
Anything outside the list parses to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubjay.functions.exprs import is_datetime_type, is_string_type

# Parse formats in trial order, as (Spark pattern, strptime pattern).
PARSE_FORMATS = (
    ("yyyy-M-d", "%Y-%m-%d"),
    ("yyyy-M-d H:m:s", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-M-d'T'H:m:s", "%Y-%m-%dT%H:%M:%S"),
    ("M/d/yyyy", "%m/%d/%Y"),
    ("d/M/yyyy", "%d/%m/%Y"),
    ("M-d-yyyy", "%m-%d-%Y"),
    ("d-M-yyyy", "%d-%m-%Y"),
    ("MMMM d, yyyy", "%B %d, %Y"),
    ("MMM d, yyyy", "%b %d, %Y"),
    ("yyyyMMdd", "%Y%m%d"),
)

# Cheap shape checks run before each parse attempt, so text that cannot match
# a format never reaches the (exception-driven) failure path of the parser.
_M = r"(0?[1-9]|1[0-2])"            # month 1-12
_D = r"(0?[1-9]|[12][0-9]|3[01])"   # day 1-31
_T = r"([01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]"
_Y = r"[0-9]{4}"
PARSE_GUARDS = {
    "yyyy-M-d": rf"^{_Y}-{_M}-{_D}$",
    "yyyy-M-d H:m:s": rf"^{_Y}-{_M}-{_D} {_T}$",
    "yyyy-M-d'T'H:m:s": rf"^{_Y}-{_M}-{_D}T{_T}$",
    "M/d/yyyy": rf"^{_M}/{_D}/{_Y}$",
    "d/M/yyyy": rf"^{_D}/{_M}/{_Y}$",
    "M-d-yyyy": rf"^{_M}-{_D}-{_Y}$",
    "d-M-yyyy": rf"^{_D}-{_M}-{_Y}$",
    "MMMM d, yyyy": rf"^[A-Za-z]{{3,9}} {_D}, {_Y}$",
    "MMM d, yyyy": rf"^[A-Za-z]{{3}} {_D}, {_Y}$",
    "yyyyMMdd": rf"^{_Y}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$",
}


#: Longest text that any format reads (``September 30, 2024`` has 18 characters, a date with a time 19).
LONGEST = 19
# How every format's text begins: other text is turned away by one look.
_ANY_SHAPE = r"^([0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]|[0-9]{8}$|[A-Za-z]{3,9} [0-9])"
# Formats that read the same text with month and day exchanged.
_EXCHANGED = {"M/d/yyyy": "d/M/yyyy", "M-d-yyyy": "d-M-yyyy"}
# Both parts can be a month.
_BOTH_MONTHS = rf"^{_M}[-/]{_M}[-/]"


def try_parse(c: Column, java: str) -> Column:
    """``try_to_timestamp`` behind the format's shape check."""
    guard = PARSE_GUARDS.get(java)
    parsed = F.try_to_timestamp(c, F.lit(java))
    return F.when(c.rlike(guard), parsed) if guard else parsed


def _shapes() -> list:
    """(format, shape) such that the first shape a text has decides its format.

    A text with the shape of two formats either reads the same under both
    (``May 5, 2024``; other words of three letters are no full month names), or
    is month-first where it can be: then, if the month has no such day, the day
    is over 12 and day-first fails, too."""
    order = [java for java, _ in PARSE_FORMATS if java != "MMMM d, yyyy"] + ["MMMM d, yyyy"]
    return [(java, PARSE_GUARDS[java]) for java in order]


def _by_shape(c: Column, value) -> Column:
    """``value(format)`` of the one format that the text's shape allows, else null."""
    (first, shape), *others = _shapes()
    chosen = F.when(c.rlike(shape), value(first))
    for java, shape in others:
        chosen = chosen.when(c.rlike(shape), value(java))
    return F.when((F.length(c) <= LONGEST) & c.rlike(_ANY_SHAPE), chosen)


def date_class(c: Column) -> Column:
    """Which formats read a text, as one small integer (null: none): the place
    of its format in ``PARSE_FORMATS``, plus their number where a second format
    reads it as well.  A text is parsed at most once; ``class_counts`` gives the
    count of each format from counts of classes."""
    places = {java: i for i, (java, _) in enumerate(PARSE_FORMATS)}

    def place(java: str) -> Column:
        i, n = places[java], len(places)
        both = c.rlike(_BOTH_MONTHS) if java in _EXCHANGED else F.lower(F.substring(c, 1, 3)) == "may" if java == "MMM d, yyyy" else None
        known = F.lit(i) if both is None else F.when(both, F.lit(i + n)).otherwise(F.lit(i))
        return F.when(F.try_to_timestamp(c, F.lit(java)).isNotNull(), known)

    return _by_shape(c, place)


#: Classes that ``date_class`` can give.
DATE_CLASSES = tuple(range(len(PARSE_FORMATS))) + tuple(
    len(PARSE_FORMATS) + i for i, (java, _) in enumerate(PARSE_FORMATS) if java in _EXCHANGED or java == "MMM d, yyyy")


def class_counts(counts: dict) -> list:
    """Values that each of ``PARSE_FORMATS`` reads, from the number of values of each class."""
    n = len(PARSE_FORMATS)
    places = {java: i for i, (java, _) in enumerate(PARSE_FORMATS)}
    out = [0] * n
    for k, count in counts.items():
        out[k % n] += count
        if k >= n:
            java = PARSE_FORMATS[k - n][0]
            out[places[_EXCHANGED.get(java, "MMMM d, yyyy")]] += count
    return out


# Strftime directive -> Java DateTimeFormatter letters.
STRFTIME_TO_JAVA = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%B": "MMMM", "%b": "MMM",
    "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a", "%A": "EEEE",
    "%a": "EEE", "%j": "DDD", "%%": "%",
}

# Date-like text patterns checked for mixed formats.
DATE_TEXT_PATTERNS = (
    ("YYYY-MM-DD", r"^\d{4}-\d{2}-\d{2}$"),
    ("DD/MM/YYYY", r"^\d{2}/\d{2}/\d{4}$"),
    ("DD-MM-YYYY", r"^\d{2}-\d{2}-\d{4}$"),
)


def parse_text(c: Column, formats=PARSE_FORMATS) -> Column:
    """The first of ``formats`` that reads the text; of the standard ones only
    that which the text's shape allows is tried."""
    if formats is PARSE_FORMATS:
        return _by_shape(c, lambda java: F.try_to_timestamp(c, F.lit(java))).cast("timestamp_ntz")
    tried = [try_parse(c, java) for java, _ in formats]
    return F.coalesce(*tried).cast("timestamp_ntz")


def to_ts(c: Column, dt: T.DataType, formats=PARSE_FORMATS) -> Column:
    """Coerce a column to ``timestamp_ntz``; unparseable text becomes null."""
    if isinstance(dt, T.TimestampNTZType):
        return c
    if is_datetime_type(dt):
        return c.cast("timestamp_ntz")
    if is_string_type(dt):
        return parse_text(c, formats)
    return F.lit(None).cast("timestamp_ntz")


def strftime_to_java(fmt: str) -> str:
    """Translate a strftime format into a Java pattern, quoting literal letters."""
    out, i, lit_run = [], 0, []

    def flush():
        if lit_run:
            text = "".join(lit_run).replace("'", "''")
            out.append("'" + text + "'")
            lit_run.clear()

    while i < len(fmt):
        two = fmt[i:i + 2]
        if fmt[i] == "%":
            if two not in STRFTIME_TO_JAVA:
                raise ValueError(f"unsupported date directive {two!r}")
            flush()
            out.append(STRFTIME_TO_JAVA[two] if two != "%%" else "'%'")
            i += 2
            continue
        ch = fmt[i]
        if ch.isalpha() or ch == "'":
            lit_run.append(ch)
        else:
            flush()
            out.append(ch)
        i += 1
    flush()
    return "".join(out)
