"""Time values: dates and numbers of steps, each comparable only with its own kind.

Texts of the form YYYY, YYYY-MM, YYYY-MM-DD, YYYYMMDD or an ISO date and time are dates (days since 0001-01-01, that day
being 1, with a fraction); a zone is converted to UTC. Other texts of digits, and numbers, are numeric steps. A struct of
(kind, val) orders as pairs do, dates before steps. The typed value is kept through every operator, so
a step of 1953 never turns into the year 1953.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = "struct<kind:string,val:double>"
TIME = "struct<kind:string,val:double,shown:string>"

_CLOCK = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)(Z|[+-]\d{2}:\d{2})?$"


def _key(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("val")))


def _days(day: Column) -> Column:
    return F.date_diff(day, F.lit("0001-01-01").cast("date")) + 1


def of_timestamp(value: Column) -> Column:
    """Of a date or timestamp column without a zone."""
    stamp = value.cast("timestamp_ntz")
    part = (F.hour(stamp) * 3600 + F.minute(stamp) * 60 + F.second(stamp)) / 86400.0
    return _key("datetime", _days(value.cast("date")) + part)


def of_number(value: Column) -> Column:
    return _key("numeric", value.cast("double"))


def of_text(value: Column) -> Column:
    """Null where the text, trimmed, is neither a date nor digits."""
    value = F.trim(value)
    day = (
        F.when(value.rlike(r"^\d{4}$"), F.concat(value, F.lit("-01-01")))
        .when(value.rlike(r"^\d{4}-\d{2}$"), F.concat(value, F.lit("-01")))
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value)
        .when(value.rlike(r"^\d{8}$"), F.regexp_replace(value, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
    )
    date_key = _days(day.try_cast("date"))
    clock = F.rpad(F.regexp_extract(value, _CLOCK, 2), 8, ":00")
    part = (F.substring(clock, 1, 2).try_cast("int") * 3600 + F.substring(clock, 4, 2).try_cast("int") * 60 + F.regexp_replace(F.regexp_extract(value, _CLOCK, 2), r"^\d{2}:\d{2}:?", "").try_cast("double")) / 86400.0
    part = F.coalesce(part, (F.substring(clock, 1, 2).try_cast("int") * 3600 + F.substring(clock, 4, 2).try_cast("int") * 60) / 86400.0)
    zone = F.regexp_extract(value, _CLOCK, 3)
    shift = F.when(zone.isin("", "Z"), 0.0).otherwise(
        F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1) * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 5, 2).try_cast("int") * 60) / 86400.0
    )
    moment = F.when(value.rlike(_CLOCK), _days(F.regexp_extract(value, _CLOCK, 1).try_cast("date")) + part - shift)
    steps = F.when(value.rlike(r"^\d+$"), value.try_cast("double"))
    return F.coalesce(_key("datetime", date_key), _key("datetime", moment), _key("numeric", steps))


def of_point(value: Column) -> Column:
    """Of a point of a narrative given as text: a number is a step, whatever its number of digits; else as of_text."""
    number = F.trim(value).try_cast("double")
    return F.coalesce(_key("numeric", number), of_text(F.trim(value)))


def literal(when: int | float | str) -> Column:
    """The key of a Python value, or a column of keys as it is; ValueError if it is no time."""
    if isinstance(when, Column):
        return when
    if isinstance(when, bool) or when is None or when == "":
        raise ValueError(f"not a time: {when!r}")
    return of_number(F.lit(float(when))) if isinstance(when, (int, float)) else of_text(F.lit(str(when)))


def comparable(a: Column, b: Column) -> Column:
    return F.coalesce(a["kind"] == b["kind"], F.lit(False))


def lag(earlier: Column, later: Column) -> Column:
    """later - earlier, null if they are not comparable."""
    return F.when(comparable(earlier, later), later["val"] - earlier["val"])
