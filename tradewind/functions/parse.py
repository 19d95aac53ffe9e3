"""Text to typed values.

Lenient parsers turn bad text into NULL. Strict ones fail the job on it, whether or not the session
runs in ANSI mode. Times are UTC wall-clock times (TIMESTAMP_NTZ), so that results do not depend on
the session time zone. Spark's casts ignore whitespace around a value.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


# A date, maybe a time of day, and maybe "UTC", "Z" or an offset. Spark's cast would ignore what follows the time.
_ZONED = r"^\s*(\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?)\s*(?:UTC|Z|([+-]\d{2}:?\d{2}))?\s*$"
# What nearly all times look like: the cast alone reads these as the pattern above would, at a fraction of its cost.
_PLAIN = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)?$"
_YEAR_OR_MONTH = r"^\s*\d{4}(-\d{1,2})?\s*$"


def _utc(c: Column) -> Column:
    """The wall-clock time in UTC, an offset taken off; NULL for any other text, with it any other name of a zone."""
    return F.when(c.rlike(_PLAIN), c.try_cast("timestamp_ntz")).when(c.isNotNull(), _zoned(c))


def _zoned(c: Column) -> Column:
    """``_utc`` of texts of any form."""
    local = F.regexp_extract(c, _ZONED, 1).try_cast("timestamp_ntz")
    offset = F.regexp_extract(c, _ZONED, 2)
    minutes = F.substring(offset, 2, 2).try_cast("int") * 60 + F.right(offset, F.lit(2)).try_cast("int")
    ahead = F.when(offset == "", 0).when(F.left(offset, F.lit(1)) == "+", minutes).otherwise(-minutes)
    return F.when(local.isNotNull(), F.timestamp_add("MINUTE", -ahead, local))


def lenient_timestamp(c: Column) -> Column:
    """Times as in ``strict_utc_timestamp``, and a year or month alone as its first instant."""
    return F.coalesce(_utc(c), F.when(c.rlike(_YEAR_OR_MONTH), c.try_cast("timestamp_ntz")))


def lenient_date(c: Column) -> Column:
    return lenient_timestamp(c).cast("date")


# Decimal or exponent notation, or infinity. Spark's cast would also read "12d", "2.5f" and "0x1p3".
_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"


def lenient_double(c: Column) -> Column:
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def whole(c: Column) -> Column:
    """A number as a 64-bit integer if it has no fraction, else NULL."""
    return F.when(c == F.floor(c), c.try_cast("bigint"))


# Digits and a fraction of zeros; or digits, the zeros after them, a fraction without its last zeros, and an exponent.
_WHOLE = r"^\s*[+-]?(\d+\.?0*|\.0+)\s*$"
_SCIENTIFIC = r"(?i)^\s*[+-]?0*(\d*?)(0*)(?:\.(\d*?)0*)?e([+-]?\d+)\s*$"


def _is_whole(c: Column) -> Column:
    """The text is a whole number, judged by its own digits: no cast that drops digits decides."""
    digits, zeros, fraction, exponent = (F.regexp_extract(c, _SCIENTIFIC, g) for g in (1, 2, 3, 4))
    power = exponent.try_cast("int")
    places = F.length(fraction) - power  # digits behind the point, or how many zeros before it must give way
    whole = F.when(F.length(fraction) > 0, places <= 0).otherwise((F.length(digits) == 0) | (F.length(zeros) >= -power))
    return c.rlike(_WHOLE) | (c.rlike(_NUMBER) & c.rlike(_SCIENTIFIC) & F.coalesce(whole, F.lit(False)))


def lenient_long(c: Column) -> Column:
    """Whole numbers, also when written with a fraction of zero ("146.0") or an exponent; 64-bit ids stay exact."""
    return F.coalesce(c.try_cast("bigint"), F.when(_is_whole(c), F.trim(c).try_cast("decimal(38,0)").try_cast("bigint")))


def strict_long(c: Column, name: str, kept: Column | None = None) -> Column:
    """Whole number that must be there: NULL and bad text are errors."""
    return _guarded(F.coalesce(lenient_long(c), _fail(name, c, "bigint")), kept)


def strict_utc_timestamp(c: Column, name: str, kept: Column | None = None) -> Column:
    """Time written as "2019-10-01 00:00:00 UTC", or with an offset, which is taken off.

    NULL stays NULL. Bad text, and with it any other name of a zone, is an error.
    """
    return _guarded(F.when(c.isNotNull(), F.coalesce(_utc(c), _fail(name, c, "timestamp_ntz"))), kept)


def _guarded(value: Column, kept: Column | None) -> Column:
    """``kept`` is the condition of the rows that matter, if others are filtered out.

    The optimizer may move the conversion below that filter, for one through a join, so the
    conversion itself must know which rows cannot fail.
    """
    return value if kept is None else F.when(kept, value)


def _fail(name: str, c: Column, type_name: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"bad value in {name}: "), F.coalesce(c, F.lit("NULL")))).cast(type_name)
