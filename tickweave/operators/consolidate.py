"""Merge split executions, net cancellations, bound the time range."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import signed_size
from ..functions.times import DAY, EXCHANGE_ZONE, local_midnight, micros, second_of
from .spread import DEFAULT, Spread, running_totals


def consolidate(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    size: str,
    cancel: Column,
    order: Sequence[str],
    payload: Sequence[str],
    size_as: str = "size",
    flags_as: str | None = None,
) -> DataFrame:
    """One row per (keys, bucket) with its net size; net sizes <= 0 are dropped.

    ``payload`` comes from one and the same row, the first by ``order``. Sum and
    first row combine before the shuffle, so a hot group costs one row per task.
    """
    netted = df.select(
        *keys,
        bucket.alias("_bucket"),
        signed_size(F.col(size), cancel).alias("_signed"),
        F.struct(*payload).alias("_row"),
        F.struct(*order).alias("_order"),
    )
    out = (
        netted.groupBy(*keys, "_bucket")
        .agg(F.sum("_signed").alias(size_as), F.min_by("_row", "_order").alias("_row"))
        .where(F.col(size_as) > 0)
        .select(*keys, size_as, *[F.col(f"_row.{c}").alias(c) for c in payload])
    )
    return out if flags_as is None else out.withColumn("flags", F.lit(flags_as))


def trade_second(df: DataFrame, ts: str = "tradeTime") -> Column:
    """Consolidation bucket: the whole second of the trade."""
    return second_of(df, ts)


def within_days(
    df: DataFrame, ts: str, start: dt.date, end: dt.date, zone: str | None = EXCHANGE_ZONE
) -> DataFrame:
    """Rows from 00:00 local of ``start`` up to, not including, 00:00 after ``end``.

    The bounds are whole seconds, so the same filter may run on the raw rows
    before :func:`consolidate`: a one-second group is inside or outside as a
    whole. That is where it saves the shuffle.
    """
    value = micros(df, ts)
    low = local_midnight(F.lit(start), zone)
    high = local_midnight(F.lit(end + dt.timedelta(days=1)), zone)
    return df.where((value >= low) & (value < high))


def split_executions(df: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Orders executed in parts: keys that occur on more than one row."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("parts"), F.sum(size).alias("total_size"))
        .where(F.col("parts") > 1)
    )


def drop_cancelled_pairs(
    df: DataFrame,
    keys: Sequence[str],
    cancel: Column,
    axis: str,
    order: Sequence[str],
    spread: Spread = DEFAULT,
) -> DataFrame:
    """Remove each cancellation together with one original of the same keys.

    The n-th cancellation takes the n-th original; what has no partner stays.
    Running counts of both sides decide it in one pass, without a join.
    """
    marked = df.withColumn("_cancel", cancel).withColumn("_axis", micros(df, axis))
    counted = running_totals(
        marked,
        keys,
        "_axis",
        [F.col("_axis"), *[F.col(c) for c in order]],
        {
            "_c": F.col("_cancel").cast("int"),
            "_o": (~F.col("_cancel")).cast("int"),
        },
        spread,
        order,
    )
    pairs = F.least("_c_total", "_o_total")
    place = F.when(F.col("_cancel"), F.col("_c")).otherwise(F.col("_o"))
    return counted.where(place > pairs).select(*df.columns)


def flag_profile(df: DataFrame, flags: str = "flags", separator: str = ";") -> DataFrame:
    """Rows per single flag of a separated flag list."""
    single = F.explode(F.split(F.coalesce(F.col(flags), F.lit("")), separator))
    return (
        df.select(single.alias("flag"))
        .where(F.col("flag") != "")
        .groupBy("flag")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
