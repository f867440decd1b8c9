"""Raw daily files or trade rows to a consolidated table of active securities."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.cells import is_cancel
from ..functions.times import EXCHANGE_ZONE, local_date
from ..operators.consolidate import consolidate, trade_second, within_days
from ..operators.dedupe import keep_last
from ..operators.trading_calendar import trading_calendar
from ..operators.universe import universe_active_days, universe_any_day
from ..session import stage
from ..sources.daily_files import (
    clean_trades, file_headers, files_for_days, files_near, list_files, read_cells,
)

# Columns of one trade besides the grouping keys.
FIRST_OF = ["tradeTime", "publishedTime", "TVTIC", "mic", "currency", "quotation"]
ORDER = ["tradeTime", "publishedTime", "TVTIC"]


def consolidated_small(
    trades: DataFrame, min_count: int = 10, min_volume: float = 5000.0,
    zone: str | None = EXCHANGE_ZONE, payload: Sequence[str] = (*FIRST_OF, "flags"),
    order: Sequence[str] = ORDER, tie: Sequence[str] = (),
    keep_null_keys: bool = False,
) -> DataFrame:
    """Latest row per id over all files, one row per (isin, second, price), and
    only securities with one lively day. The merged rows are stored once, as the
    activity count and the result both read them. Rows without an id count as one
    row unless ``keep_null_keys``."""
    latest = keep_last(trades, ["TVTIC"], ["publishedTime", *tie], keep_null_keys=keep_null_keys)
    merged = consolidate(
        latest, ["isin", "price"], trade_second(latest), "size", is_cancel(F.col("flags")),
        [*order, *tie], payload, size_as="total_size",
    )
    merged = stage(merged)
    day = local_date(merged, "tradeTime", zone)
    return universe_any_day(merged, "isin", day, "price", "total_size", min_count, min_volume)


def consolidated_large(
    trades: DataFrame, start: dt.date, end: dt.date, min_volume: float = 5000.0, slack: int = 25,
    scope: Sequence[str] = ("source",), zone: str | None = EXCHANGE_ZONE,
    payload: Sequence[str] = FIRST_OF, order: Sequence[str] = ORDER, tie: Sequence[str] = (),
    keep_null_keys: bool = False,
) -> DataFrame:
    """Latest row per id and file, merged, bounded in time, and only securities
    active on all but ``slack`` trading days. The time bound sits before the
    merge, where it has the same effect and saves the shuffle, but after the
    removal of duplicates: a newer row of an id may lie outside the range.
    """
    latest = keep_last(trades, ["TVTIC"], ["publishedTime", *tie], scope, keep_null_keys)
    bounded = within_days(latest, "tradeTime", start, end, zone)
    merged = consolidate(
        bounded, ["isin", "price"], trade_second(bounded), "size", is_cancel(F.col("flags")),
        [*order, *tie], payload, flags_as="ALGO;",
    )
    merged = stage(merged)
    calendar = trading_calendar(trades.sparkSession, start, end)
    day = local_date(merged, "tradeTime", zone)
    return universe_active_days(
        merged, "isin", day, "price", "size", calendar, start, end, min_volume, slack
    )


def consolidated_from_files(
    spark: SparkSession, root: str, start: dt.date, end: dt.date, glob: str = "*.csv",
    quoting: bool = True, **options,
) -> DataFrame:
    """The large plan from a folder of daily files; far-off files are not opened."""
    files = files_near(list_files(spark, root, glob), start, end)
    cells = read_cells(spark, file_headers(spark, files, whole=True), quoting=quoting)
    return consolidated_large(clean_trades(cells, quoting), start, end, **options)


def active_once_from_files(
    spark: SparkSession, root: str, start: dt.date, end: dt.date, glob: str = "*.csv", **options
) -> DataFrame:
    """The small plan from the files of the trading days in the range."""
    calendar = trading_calendar(spark, start, end + dt.timedelta(days=14))
    files = files_for_days(list_files(spark, root, glob), calendar, start, end)
    return consolidated_small(clean_trades(read_cells(spark, file_headers(spark, files, whole=True))), **options)
