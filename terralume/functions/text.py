"""Lenient parsing of text cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal numbers and infinities only: no suffixes, separators, hexadecimals or nan.
_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?)\s*$"
_FORMATS = ("yyyy/M/d", "yyyy/M/d H:m", "yyyy/M/d H:m:s", "M/d/yyyy", "M/d/yyyy H:m", "M/d/yyyy H:m:s", "d/M/yyyy", "d/M/yyyy H:m", "d/M/yyyy H:m:s", "yyyyMMdd", "yyyyMMdd'T'HHmmss", "MMM d yyyy", "d MMM yyyy", "MMMM d, yyyy", "yyyy.M.d")


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(strip(c.cast("string")), F.lit("")) == ""


def number(c: Column, dtype: str = "string") -> Column:
    """A double, or null for what isn't a decimal number; booleans count as 1 and 0."""
    if dtype != "string":
        d = c.cast("double")
        return F.when(~F.isnan(d), d)
    d = F.when(c.rlike(_NUMBER), c.try_cast("double"))
    overflow = c.rlike(r"\d") & (F.abs(d) == F.lit(float("inf")))
    return F.when(~overflow, d)


# A zone at the end of a text with a time.
_ZONE = r"(?i)(?<=\d)\s*(Z|UTC|GMT|[+-]\d{2}(:?\d{2})?)$"


def utc(instant: Column) -> Column:
    """timestamp_ntz that shows an instant in UTC, whatever the session's zone."""
    micros = F.unix_micros(instant)
    day = F.lit(86_400_000_000)
    seconds = (F.pmod(micros, day).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.floor(micros / day).cast("int"), F.lit(0), F.lit(0), seconds)


def zoned(c: Column) -> Column:
    """Whether a text is a time with a zone."""
    s = strip(c)
    return s.rlike(_ZONE) & s.rlike(r"\d:\d")


def iso(c: Column) -> Column:
    """A text's time in ISO form, its own zone as an offset behind it and a fraction if there is one; null for what isn't a time."""
    s = strip(c)
    wall = timestamp(F.when(zoned(c), F.regexp_replace(s, _ZONE, "")).otherwise(s))
    offset = F.upper(F.regexp_extract(s, _ZONE, 1))
    digits = F.regexp_replace(offset, "[^0-9]", "")
    offset = F.when(digits == "", F.lit("+00:00")).otherwise(F.concat(F.substring(offset, 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.rpad(F.substring(digits, 3, 2), 2, "0")))
    fraction = F.date_format(wall, ".SSSSSS")
    return F.when(timestamp(c).isNotNull(), F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == ".000000", "").otherwise(fraction), F.when(zoned(c), offset).otherwise("")))


def timestamp(c: Column, dtype: str = "string") -> Column:
    """timestamp_ntz in UTC, or null. Month-first wins over day-first; clock-dependent texts are not dates."""
    if dtype == "timestamp":
        t = utc(c)
    elif dtype.startswith(("timestamp", "date")):
        t = c.cast("timestamp_ntz")
    elif dtype != "string":
        t = utc(F.timestamp_micros((c.cast("double") / 1000).cast("long")))  # numeric cells are nanoseconds
    else:
        s = strip(c)
        tries = [s.try_cast("timestamp"), *(F.try_to_timestamp(s, F.lit(f)) for f in _FORMATS)]
        wall = F.coalesce(*tries).cast("timestamp_ntz")  # a text without zone is read and shown in the session's
        t = F.when(s.rlike(r"\d") & ~s.rlike(r"^T?\d{1,2}:"), F.when(zoned(s), utc(s.try_cast("timestamp"))).otherwise(wall))
    return F.when(t.between(F.lit("1677-09-22").cast("timestamp_ntz"), F.lit("2262-04-11").cast("timestamp_ntz")), t)


def json_row(columns: list[Column]) -> Column:
    """A JSON object that keeps nulls; NaN becomes null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
