"""Typed values out of raw text cells; a bad cell becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: shape of the exchange's time stamps, fraction and zone mark optional.
TIME_SHAPE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?Z?$"


def parse_instant(text: Column) -> Column:
    """UTC text such as ``2024-04-03T08:00:00.123Z`` as a timestamp."""
    utc = F.concat(F.regexp_replace(text, "Z$", ""), F.lit("Z"))
    return F.when(text.rlike(TIME_SHAPE), F.try_to_timestamp(utc))


def parse_price(text: Column) -> Column:
    """Number with a decimal comma or point; grouped digits are no number, nor
    are the type letters (``1.5d``) that a cast would take."""
    value = F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~text.rlike(r"\d[dDfF]\s*$"), value)


def parse_size(text: Column) -> Column:
    """Whole number of shares."""
    return text.try_cast("bigint")


def unquote(text: Column) -> Column:
    """Drop the double quotes at both ends."""
    return F.trim(text, F.lit('"'))


def tidy(text: Column) -> Column:
    """Null becomes the empty string; white space at both ends goes."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def is_cancel(flags: Column, mark: str = "CANC") -> Column:
    """True for a cancellation; null flags count as a normal trade."""
    return F.coalesce(flags.contains(mark), F.lit(False))


def signed_size(size: Column, cancel: Column) -> Column:
    """Cancelled shares count negative; amendments are added as they are."""
    return F.when(cancel, -size).otherwise(size)


def percent_text(share: Column, digits: int = 2) -> Column:
    """Share as percent text, halves to the even digit."""
    return F.format_string(f"%.{digits}f%%", F.bround(share * 100, digits))


def number_text(value: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(value, digits))
