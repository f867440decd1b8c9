"""Which securities are active enough to study."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..session import broadcast_if_small
from .trading_calendar import trading_day_count


def daily_activity(df: DataFrame, key: str, day: Column, price: str, size: str) -> DataFrame:
    """Row count and traded value per (key, day)."""
    return df.groupBy(key, day.alias("trade_day")).agg(
        F.count(F.lit(1)).alias("tx_count"),
        F.sum(F.col(size) * F.col(price)).alias("daily_volume"),
    )


def keys_active_once(activity: DataFrame, key: str, min_count: int, min_volume: float) -> DataFrame:
    """Keys with one day or more that reaches both limits."""
    lively = (F.col("tx_count") >= min_count) & (F.col("daily_volume") >= min_volume)
    return activity.where(lively).select(key).distinct()


def keys_active_often(activity: DataFrame, key: str, min_volume: float, min_days: int) -> DataFrame:
    """Keys with ``min_days`` days of enough volume; never a key without one."""
    return (
        activity.where(F.col("daily_volume") >= min_volume)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("active_days"))
        .where(F.col("active_days") >= min_days)
        .select(key)
    )


def restrict_to(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Semi join; the key list is broadcast only after its size is known."""
    return df.join(broadcast_if_small(keys), key, "left_semi")


def universe_any_day(
    df: DataFrame, key: str, day: Column, price: str, size: str,
    min_count: int = 10, min_volume: float = 5000.0,
) -> DataFrame:
    """Rows of keys with any single lively day. ``df`` is read twice: pass a stored table."""
    activity = daily_activity(df, key, day, price, size)
    return restrict_to(df, keys_active_once(activity, key, min_count, min_volume), key)


def required_days(calendar: DataFrame, start: dt.date, end: dt.date, slack: int) -> int:
    return max(0, trading_day_count(calendar, start, end) - slack)


def universe_active_days(
    df: DataFrame, key: str, day: Column, price: str, size: str, calendar: DataFrame,
    start: dt.date, end: dt.date, min_volume: float = 5000.0, slack: int = 25,
) -> DataFrame:
    """Rows of keys active on all but ``slack`` trading days. ``df`` is read twice."""
    activity = daily_activity(df, key, day, price, size)
    often = keys_active_often(activity, key, min_volume, required_days(calendar, start, end, slack))
    return restrict_to(df, often, key)
