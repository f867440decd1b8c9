"""Benchmark change, future targets and the breakout label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .asof import Lookup, asof_join, asof_join_all
from .dedupe import drop_nulls
from .spread import DEFAULT, Spread
from .time_window import Rolling, time_window


def daily_close(df: DataFrame, day: Column, price: str, order: Sequence[str]) -> DataFrame:
    """Last price per day and the close of the trading day before it."""
    closes = df.groupBy(day.alias("trade_day")).agg(
        F.max_by(price, F.struct(*order)).alias("bench_close")
    )
    # One row per trading day of one security.
    previous = F.lag("bench_close").over(Window.orderBy("trade_day"))
    return closes.withColumn("bench_prev_close", previous)


def with_benchmark_delta(
    df: DataFrame, benchmark: DataFrame, ts: str, price: str, order: Sequence[str],
    day_of, spread: Spread = DEFAULT,
) -> DataFrame:
    """Add ``bench_delta``: benchmark price now against its previous close.

    ``benchmark`` holds the ticks of one security, ``day_of(df)`` gives the
    trading day. The close table has one row per day and is broadcast.
    """
    closes = daily_close(benchmark, day_of(benchmark), price, [ts, *order])
    ticks = benchmark.select(ts, F.col(price).alias("bench_current_price"), *order)
    priced = asof_join_all(
        df, Lookup(ticks, ts, ["bench_current_price"], order), ts, spread=spread
    )
    dated = priced.withColumn("_day", day_of(priced))
    lookup = F.broadcast(closes.select(F.col("trade_day").alias("_day"), "bench_prev_close"))
    change = F.try_divide(
        F.col("bench_current_price") - F.col("bench_prev_close"), F.col("bench_prev_close")
    )
    return dated.join(lookup, "_day", "left").select(*df.columns, change.alias("bench_delta"))


def future_windows(
    ticks: DataFrame, key: str, ts: str, price: str, period: int, order: Sequence[str],
    spread: Spread = DEFAULT,
) -> DataFrame:
    """Highest and last price of the window that ends at each tick."""
    outputs = [Rolling("future_max_price", "max", price), Rolling("sell_price", "last", price)]
    return time_window(ticks, key, ts, period, outputs, order, spread)


def with_future(
    df: DataFrame, windows: DataFrame, ticks: DataFrame, key: str, ts: str, price: str,
    horizon: int, delay: int, order: Sequence[str], tolerance: int | None = None,
    spread: Spread = DEFAULT,
) -> DataFrame:
    """Add ``future_max_price``, ``sell_price`` and ``buy_price`` to each row.

    Target: the window ending at the first tick at or after ``t + horizon``.
    Buy price: the first tick at or after ``t + delay``. One forward as-of join
    finds both.
    """
    bought = ticks.withColumn("buy_price", F.col(price))
    return asof_join(
        df,
        [
            Lookup(windows, ts, ["future_max_price", "sell_price"], order, horizon),
            Lookup(bought, ts, ["buy_price"], order, delay),
        ],
        ts, [key], "forward", tolerance, spread,
    )


def breakout_label(
    df: DataFrame, future_max: str, past_max: str, factor: float = 1.005, name: str = "target_label"
) -> DataFrame:
    """1 where the future high reaches ``factor`` times the past high, else 0."""
    hit = F.col(future_max) >= F.col(past_max) * factor
    return drop_nulls(df.withColumn(name, hit.cast("int")))
