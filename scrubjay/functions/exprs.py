"""Column-expression helpers shared by every operator.

All helpers return JVM-side ``Column`` expressions (codegen friendly); none
of them is a Python UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that reads as a number (pandas ``to_numeric`` acceptance).
NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"

# Null tokens recognised when text is loaded (pandas ``read_csv`` defaults).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Unicode whitespace class used for stripping (Python ``str.strip`` set).
_WS = r"[\s\p{Z}\x{0B}\x{85}]"
STRIP_PATTERN = rf"^{_WS}+|{_WS}+$"


def col(name: str) -> Column:
    """Reference a column by its exact name (dots and spaces allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                           T.FloatType, T.DoubleType, T.DecimalType))


def is_integral_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_float_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_string_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def type_family(dt: T.DataType) -> str:
    """pandas-like dtype family: num, dt, bool, str or other."""
    if is_numeric_type(dt):
        return "num"
    if is_datetime_type(dt):
        return "dt"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if is_string_type(dt):
        return "str"
    return "other"


def strip(c: Column) -> Column:
    """Strip Unicode whitespace at both ends (Spark's ``trim`` strips spaces only)."""
    return F.regexp_replace(c, STRIP_PATTERN, "")


# Letters with case; Python title-cases words of these alone.
_CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"


def _capital(x: Column) -> Column:
    """First character in upper case; what it expands to beyond one letter is lower."""
    up = F.upper(F.substring(x, 1, 1))
    return F.concat(F.substring(up, 1, 1), F.lower(F.substring(up, 2, 8)), F.substring(x, 2, 1 << 30))


def title(c: Column) -> Column:
    """Python ``str.title``: upper-case every cased letter that follows no cased letter."""
    parts = F.split(F.lower(c), rf"(?<!{_CASED})(?={_CASED})")
    return F.array_join(F.transform(parts, _capital), "")


def has_cased(c: Column) -> Column:
    return F.lower(c) != F.upper(c)


def is_lower(c: Column) -> Column:
    return has_cased(c) & (F.lower(c) == c)


def is_upper(c: Column) -> Column:
    return has_cased(c) & (F.upper(c) == c)


# title(c) == c exactly when no upper-case letter follows a letter and no
# lower-case letter starts a word: one regex scan instead of split/transform.
_NOT_TITLE = rf"{_CASED}\p{{Lu}}|(?<!{_CASED})\p{{Ll}}"


def is_title(c: Column) -> Column:
    return has_cased(c) & ~c.rlike(_NOT_TITLE)


def epoch_nanos(c: Column, dt: T.DataType) -> Column:
    """Nanoseconds since the epoch of a date/timestamp, reading wall-clock
    (``timestamp_ntz``, ``date``) values as UTC whatever the session time zone."""
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c) * 1000
    wall = c.cast("timestamp_ntz").cast("string")
    return F.unix_micros(F.to_timestamp(F.concat(wall, F.lit("Z")), "yyyy-MM-dd HH:mm:ss[.SSSSSS]X")) * 1000


def to_num(c: Column, dt: T.DataType) -> Column:
    """Coerce any column to double the way ``pd.to_numeric(errors='coerce')`` does."""
    if is_numeric_type(dt) or isinstance(dt, T.BooleanType):
        return c.cast("double")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return epoch_nanos(c, dt).cast("double")
    if is_string_type(dt):
        return F.when(c.rlike(NUMBER_PATTERN), F.regexp_replace(c, STRIP_PATTERN, "").try_cast("double"))
    return F.lit(None).cast("double")


# Doubles from 1e16 on have no fraction; below 2^126 they are two halves of 63 bits.
_WHOLE_MIN, _WHOLE_MAX = 1e16, 2.0 ** 126


def _rounded(whole: Column, way: Column) -> Column:
    """(digits, text) of an integer's text rounded to ``way.n`` digits, ties to
    even, or ``way.up``: ``digits`` reads as a number."""
    n = way["n"]
    kept, following = F.substring(whole, F.lit(1), n).cast("long"), F.substring(whole, n + 1, F.lit(1))
    up = way["up"] | (following > "5") | ((following == "5") & (F.substring(whole, n + 2, F.lit(40)).rlike("[1-9]") | (kept % 2 == 1)))
    digits, zeros = (kept + F.when(up, 1).otherwise(0)).cast("string"), F.length(whole) - n
    text = F.regexp_replace(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 20)), r"\.?0+$", "")
    return F.struct(F.concat(digits, F.lit("e"), zeros.cast("string")).alias("digits"),
                    F.concat(text, F.lit("e+"), (zeros + F.length(digits) - 1).cast("string")).alias("text"))


def _whole_text(a: Column) -> Column:
    """``d.ddde+NN`` of a double from 1e16 to below 2^126: its exact integer
    rounded to the fewest digits that read back as the same value.  Java's own
    digits are not always the shortest, and rounding those misses the last one.
    Lambdas name the integer and its roundings once; as plain expressions they
    would be copied into every use."""
    half = F.lit(2.0 ** 63)
    hi = F.floor(a / half).cast("double")
    parts = [x.try_cast("long").cast("decimal(19,0)") for x in (hi, a - hi * half)]
    whole = (parts[0] * F.lit(str(2 ** 63)).cast("decimal(19,0)") + parts[1]).cast("string")
    # at a power of two the next lower double is nearer: the upper neighbour may read back where the nearest digits don't
    ways = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(up).alias("up")) for n, up in
                     ((15, False), (15, True), (16, False), (16, True), (17, False))])
    roundings = F.transform(F.array(whole), lambda w: F.transform(ways, lambda way: _rounded(w, way)))[0]
    return F.filter(roundings, lambda r: r["digits"].cast("double") == a)[0]["text"]


def double_to_str(c: Column) -> Column:
    """Format a double like Python's ``str(float)``: plain decimals from 1e-4 to below 1e16."""
    a, text = F.abs(c), c.cast("string")
    sign = F.when(c < 0, "-").otherwise("")
    # the fewest of 15 to 17 digits that read back as the same value
    wide = [F.format_string(f"%.{n}e", c) for n in (14, 15, 16)]
    exact = F.when(wide[0].try_cast("double") == c, wide[0]).when(wide[1].try_cast("double") == c, wide[1]).otherwise(wide[2])
    digits = F.regexp_replace(F.regexp_extract(exact, r"^-?([0-9.]+)e", 1), r"\.?0+$", "")
    far = F.concat(sign, digits, F.lit("e"), F.regexp_extract(exact, r"e([+-]\d+)$", 1))
    # 1e-4 to 1e-3: one leading digit four places behind the point
    small = F.concat(sign, F.lit("0.000"), F.regexp_replace(digits, r"\.", ""))
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(c), F.lit("nan"))
            .when(c == float("inf"), F.lit("inf"))
            .when(c == float("-inf"), F.lit("-inf"))
            .when((a >= _WHOLE_MIN) & (a < _WHOLE_MAX), F.concat(sign, _whole_text(a)))
            .when((a >= _WHOLE_MIN) | ((a < 1e-4) & (a > 0)), far)
            .when((a < 1e-3) & (a > 0), small)
            .when((c == F.floor(c)) & (a > 0), F.concat(F.floor(c).cast("long").cast("string"), F.lit(".0")))
            .when(a >= 1e7, F.regexp_replace(c.cast("decimal(38,10)").cast("string"), "0+$", ""))
            .otherwise(text))


def to_str(c: Column, dt: T.DataType) -> Column:
    """Text form of a value (pandas ``astype(str)``), nulls stay null."""
    if is_string_type(dt):
        return c
    if is_float_type(dt):
        return double_to_str(c.cast("double"))
    if isinstance(dt, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        micros = F.date_format(c, "SSSSSS")
        return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))
    return c.cast("string")


def round_half_away(c: Column, places: int) -> Column:
    """Round to ``places`` decimals, half away from zero, on the binary value
    (``round(x * 10^p) / 10^p``), as SQL engines round doubles."""
    m = float(10 ** places)
    return F.signum(c) * F.floor(F.abs(c) * F.lit(m) + F.lit(0.5)) / F.lit(m)


def pround(x, places: int):
    """Driver-side twin of ``round_half_away`` for small collected values."""
    if x is None or x != x:
        return None
    m = float(10 ** places)
    return math.copysign(math.floor(abs(float(x)) * m + 0.5) / m, float(x)) if x else 0.0


def safe_corr(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson r; null (not an error) for a constant column."""
    xm = F.when(y.isNotNull(), x)
    ym = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(xm, ym), F.stddev_samp(xm) * F.stddev_samp(ym))
