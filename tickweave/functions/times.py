"""Time columns that do not depend on the session time zone.

A ``timestamp`` column is an instant; a ``timestamp_ntz`` column is read as
UTC wall time. A "day" is the calendar day in the exchange's zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

EXCHANGE_ZONE = "Europe/Berlin"
SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of a time, date or number column."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{name}`)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("long") * DAY
    return F.col(name)


def _floor_div(value: Column, unit: int) -> Column:
    return (value - F.pmod(value, F.lit(unit).cast("long"))).cast("long") / F.lit(unit)


def local_micros(df: DataFrame, name: str, zone: str | None = EXCHANGE_ZONE) -> Column:
    """Wall-clock microseconds in ``zone`` (``None`` keeps UTC)."""
    utc = micros(df, name)
    if zone is None or zone == "UTC":
        return utc
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), zone))


def local_date(df: DataFrame, name: str, zone: str | None = EXCHANGE_ZONE) -> Column:
    """Calendar day in ``zone`` of a time column."""
    if isinstance(df.schema[name].dataType, T.DateType):
        return F.col(name)
    day = _floor_div(local_micros(df, name, zone), DAY)
    return F.date_from_unix_date(day.cast("int"))


def local_midnight(day, zone: str | None = EXCHANGE_ZONE) -> Column:
    """Epoch microseconds of 00:00 local time of a ``date`` column or literal."""
    wall = F.timestamp_micros(F.unix_date(day).cast("long") * F.lit(DAY))
    if zone is not None and zone != "UTC":
        wall = F.to_utc_timestamp(wall, zone)
    return F.unix_micros(wall)


def second_of(df: DataFrame, name: str) -> Column:
    """Epoch microseconds cut down to the whole second."""
    value = micros(df, name)
    return value - F.pmod(value, F.lit(SECOND).cast("long"))


def millis_between(later: Column, earlier: Column) -> Column:
    """Whole milliseconds between two microsecond columns, cut toward zero."""
    return ((later - earlier) / 1000).cast("long")
