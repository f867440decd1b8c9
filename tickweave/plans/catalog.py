"""Every operator as a query over the given tables, with its SQL twin."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.cells import is_cancel
from ..functions.times import HOUR, MINUTE, local_date
from ..operators import audit, consolidate as merging, dedupe, evaluate, labels, universe
from ..operators.asof import Lookup, asof_join, asof_join_all
from ..operators.boosting import Boosting, score_by_key
from ..operators.model_store import load_models
from ..operators.models import RETURN_FEATURES
from ..operators.spread import DEFAULT, Spread
from ..operators.split import chrono_split
from ..operators.tick_window import complete_tick_rows, tick_features
from ..operators.time_window import Rolling, time_window
from ..operators.trading_calendar import trading_calendar, with_prev_trading_day
from ..session import broadcast_if_small, shared_dir, stage
from ..sources.daily_files import (
    clean_trades, file_headers, files_for_days, files_near, read_cells, security_names,
    sources_with, unreadable,
)
from ..sources.tables import read_parquet, write_parquet, write_report
from . import consolidation, returns
from .breakout import BreakoutStudy
from .views import daily_files, scored_trades, table, ticks, trades

SPREAD = DEFAULT
CROWDED = Spread(min_rows=4, rows_per_bin=2)
BENCHMARK = 1
TIE = ["orderkey", "linenumber", "part"]
FIRST_DAY, LAST_DAY = dt.date(2024, 1, 1), dt.date(2024, 1, 30)


def _study() -> BreakoutStudy:
    """Durations that fit the sparse events: hours become days."""
    return BreakoutStudy(
        past=48 * HOUR, slice_from=0, slice_to=24 * HOUR, future=60 * HOUR, horizon=72 * HOUR,
        delay=30 * MINUTE, spread=SPREAD,
    )


# --- duplicates, names, unions -------------------------------------------------


def dedupe_keep_last(spark, folder):
    rows = table(spark, folder, "lineitem")
    return dedupe.keep_last(
        rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_suppkey", "l_partkey"]
    )


def dedupe_per_source(spark, folder):
    rows = table(spark, folder, "lineitem")
    return dedupe.keep_last(
        rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_suppkey", "l_partkey"],
        scope=["l_linestatus"],
    )


def latest_name(spark, folder):
    orders = table(spark, folder, "orders")
    return dedupe.latest_value(orders, "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"])


def union_drift(spark, folder):
    customers = table(spark, folder, "customer").drop("c_nationkey")
    customers = customers.withColumnsRenamed(
        {"c_custkey": "id", "c_name": "name", "c_mktsegment": "segment", "c_acctbal": "balance"}
    )
    suppliers = table(spark, folder, "supplier").drop("s_nationkey")
    aliases = {"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"}
    return dedupe.union_drifting([customers, suppliers], aliases)


def duplicate_profile(spark, folder):
    return dedupe.duplicate_profile(trades(spark, folder), "TVTIC", "mic")


def flag_profile(spark, folder):
    return merging.flag_profile(trades(spark, folder))


def cancelled_pairs(spark, folder):
    rows = trades(spark, folder).select(
        "isin", "tradeTime", F.floor(F.col("size") / 10).alias("lot"), "flags", *TIE
    )
    return merging.drop_cancelled_pairs(
        rows, ["isin", "tradeTime", "lot"], is_cancel(F.col("flags")), "orderkey", TIE, SPREAD
    )


def split_executions(spark, folder):
    return merging.split_executions(trades(spark, folder), ["isin", "tradeTime", "mic"], "size")


# --- consolidation and universe ------------------------------------------------


def consolidate_signed(spark, folder):
    rows = ticks(spark, folder).withColumn("band", F.floor(F.col("price") / 10))
    return merging.consolidate(
        rows, ["isin", "band"], local_date(rows, "tradeTime"), "size",
        is_cancel(F.col("flags")), ["tradeTime", "TVTIC"], ["tradeTime", "TVTIC", "mic"],
        flags_as="ALGO;",
    )


def _coarse(rows: DataFrame, unit: str, step: int) -> DataFrame:
    """Times and prices cut off, so that several trades share both."""
    kind = rows.schema["tradeTime"].dataType
    return rows.withColumns(
        {
            "tradeTime": F.date_trunc(unit, "tradeTime").cast(kind),
            "price": F.floor(F.col("price") / step) * float(step) + 1.0,
        }
    )


def consolidated_small(spark, folder):
    return consolidation.consolidated_small(
        _coarse(trades(spark, folder), "MONTH", 20_000), 2, 60000.0, payload=["tradeTime", "TVTIC", "flags", "mic", "part"],
        order=["tradeTime", "publishedTime", "TVTIC"], tie=["isin", "part"],
    )


def consolidated_large(spark, folder):
    return consolidation.consolidated_large(
        _coarse(ticks(spark, folder), "DAY", 50), dt.date(2024, 1, 3), dt.date(2024, 1, 26), 2000.0, 8,
        scope=["mic"], payload=["tradeTime", "TVTIC", "mic"],
    )


def time_bound(spark, folder):
    return merging.within_days(
        ticks(spark, folder), "tradeTime", dt.date(2024, 1, 3), dt.date(2024, 1, 26)
    )


def daily_activity(spark, folder):
    rows = ticks(spark, folder)
    activity = universe.daily_activity(
        rows, "isin", local_date(rows, "tradeTime"), "price", "size"
    )
    return activity.withColumn("daily_volume", F.round("daily_volume", 2))


def universe_any_day(spark, folder):
    rows = ticks(spark, folder)
    return universe.universe_any_day(
        rows, "isin", local_date(rows, "tradeTime"), "price", "size", 6, 10000.0
    )


def universe_enough_days(spark, folder):
    rows = ticks(spark, folder)
    calendar = trading_calendar(spark, FIRST_DAY, LAST_DAY)
    return universe.universe_active_days(
        rows, "isin", local_date(rows, "tradeTime"), "price", "size", calendar,
        FIRST_DAY, LAST_DAY, 2000.0, 2,
    )


# --- calendar and audits ---------------------------------------------------------


def _order_days(spark, folder) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.select("o_orderkey", local_date(orders, "o_orderdate", None).alias("order_day"))


def _calendar_of(days: DataFrame, day: str) -> DataFrame:
    first, last = days.agg(F.min(day), F.max(day)).first()
    return trading_calendar(days.sparkSession, first, last)


def prev_trading_day(spark, folder):
    days = _order_days(spark, folder)
    return with_prev_trading_day(days, _calendar_of(days, "order_day"), "order_day")


def trading_days_by_month(spark, folder):
    days = _order_days(spark, folder)
    calendar = _calendar_of(days, "order_day")
    sold = days.groupBy("order_day").agg(F.count(F.lit(1)).alias("n"))
    joined = calendar.join(F.broadcast(sold), calendar["d"] == sold["order_day"], "left")
    return joined.groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(
        F.count_if("is_trading").alias("trading_days"),
        F.count("holiday").alias("holidays"),
        F.coalesce(F.sum(F.when(F.col("is_trading"), F.col("n"))), F.lit(0)).alias("orders"),
    )


def _busy_days(spark, folder) -> DataFrame:
    """Days with at least the average number of ticks stand for valid files."""
    rows = ticks(spark, folder)
    per_day = rows.groupBy(local_date(rows, "tradeTime").alias("day")).count()
    per_day = stage(per_day)
    limit = per_day.agg(F.avg("count")).first()[0]
    return per_day.where(F.col("count") >= limit).withColumn(
        "source", F.concat(F.lit("trades_"), F.date_format("day", "yyyyMMdd"))
    )


def coverage_report(spark, folder):
    calendar = trading_calendar(spark, FIRST_DAY, LAST_DAY)
    return audit.coverage(_busy_days(spark, folder), calendar, "day", "source")


def missing_by_month(spark, folder):
    return audit.missing_by_month(coverage_report(spark, folder))


def last_day_position(spark, folder):
    """First row, in file order, of the last day of each source."""
    rows = ticks(spark, folder)
    dated = rows.select("mic", "TVTIC", local_date(rows, "tradeTime").alias("day"))
    numbered = audit.row_numbers(dated, "mic", "TVTIC", spread=SPREAD)
    first = numbered.groupBy("mic", "day").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_num").alias("row_num")
    )
    return first.groupBy("mic").agg(
        F.sum("n").alias("rows"), F.min("day").alias("min_date"), F.max("day").alias("max_date"),
        F.max_by("row_num", "day").alias("max_date_first_row"),
    )


def _files_calendar(spark) -> DataFrame:
    return trading_calendar(spark, dt.date(2023, 12, 1), dt.date(2024, 3, 1))


def files_chosen(spark, folder):
    """Which files a date range opens: by the coarse rule and by the exact one."""
    files = daily_files(spark, folder)
    start, end = dt.date(2024, 1, 12), dt.date(2024, 1, 19)
    near = files_near(files, start, end, 5).select("source").distinct()
    exact = files_for_days(files, _files_calendar(spark), start, end).select("source").distinct()
    named = files.select("source", "file_date").distinct()
    for name, chosen in [("near", near), ("exact", exact)]:
        named = named.join(broadcast_if_small(chosen.withColumn(name, F.lit(True))), "source", "left")
    return named.fillna(False, ["near", "exact"])


def sources_with_names(spark, folder):
    return sources_with(spark, _with_headers(spark, folder)[1], "displayName")


def unreadable_files(spark, folder):
    return unreadable(spark, _with_headers(spark, folder)[1]).select("source")


def _with_headers(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The listing, and the same with headers; damaged files are known by then."""
    files = daily_files(spark, folder)
    return files, stage(file_headers(spark, files, whole=True))


def first_file_rows(spark, folder):
    cells = read_cells(spark, _with_headers(spark, folder)[1], ["TVTIC", "orderId"])
    return audit.first_rows(cells, 100).select("source", "TVTIC")


def file_date_audit(spark, folder):
    files, headed = _with_headers(spark, folder)
    cells = read_cells(spark, headed, ["tradeTime"])
    found = audit.audit_file_dates(
        files, cells, _files_calendar(spark), with_column=sources_with(spark, headed, "tradeTime"),
        failed=unreadable(spark, headed),
    )
    # Counts that may be null: as doubles, which client tables of both sides show alike.
    return found.withColumns({c: F.col(c).cast("double") for c in ("rows", "max_date_first_row")})


def file_audit_summary(spark, folder):
    return audit.audit_summary(file_date_audit(spark, folder))


def _assigned(spark, folder, sample_rows: int | None = None) -> DataFrame:
    files, headed = _with_headers(spark, folder)
    cells = read_cells(spark, headed, ["tradeTime"])
    # A floor that the files without trades fail: the days' files hold more than this.
    found = audit.assign_file_dates(
        files, cells, _files_calendar(spark), min_bytes=340, sample_rows=sample_rows
    )
    return found.drop("file_size")


def file_majority_date(spark, folder):
    return _assigned(spark, folder)


def file_majority_of_head(spark, folder):
    """The quick check: the first 100 rows of a file decide."""
    return _assigned(spark, folder, 100)


def coverage_counts(spark, folder):
    calendar = trading_calendar(spark, FIRST_DAY, LAST_DAY)
    return audit.coverage_counts(_busy_days(spark, folder), calendar, "day", "source")


def _utc(name: str):
    wall = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(name).cast("timestamp_ntz"))
    return wall.alias(name)


def _typed(spark, folder, quoting: bool) -> DataFrame:
    rows = clean_trades(read_cells(spark, _with_headers(spark, folder)[1], quoting=quoting), quoting)
    return rows.select(
        "source", "isin", _utc("tradeTime"), _utc("publishedTime"), "price", "size",
        "quotation", "currency", "TVTIC", "mic", "flags",
    )


def ingest_quoted(spark, folder):
    return _typed(spark, folder, True)


def ingest_unquoted(spark, folder):
    """Quotes taken as plain characters: a ``;`` inside flags ends the cell, and
    what follows flags in that layout is lost."""
    return _typed(spark, folder, False)


def ingest_security_names(spark, folder):
    files, headed = _with_headers(spark, folder)
    return security_names(read_cells(spark, headed, ["isin", "displayName"]), files)


def stored_by_day(spark, folder):
    """Parquet sink by day; reading a range of days opens only their folders."""
    rows = ticks(spark, folder)
    path = shared_dir(spark)
    write_parquet(
        rows.withColumn("trade_day", local_date(rows, "tradeTime")), path, "trade_day",
        sort_by=("isin", "tradeTime"),
    )
    days = F.col("trade_day").between(F.lit(dt.date(2024, 1, 9)), F.lit(dt.date(2024, 1, 18)))
    return read_parquet(spark, path).where(days)


def report_file(spark, folder):
    """CSV sink of the report, read back as text."""
    path = shared_dir(spark)
    write_report(strategy_report(spark, folder), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(
        F.col("ISIN").cast("bigint").alias("ISIN"), "Optimal_Threshold",
        F.col("ROC_AUC_Score").cast("double").alias("ROC_AUC_Score"), "Signal_Dates",
    )


# --- windows and as-of joins -------------------------------------------------------


def _features(spark, folder) -> DataFrame:
    rows = trades(spark, folder).select("isin", "tradeTime", *TIE, "price", "size")
    return complete_tick_rows(tick_features(rows, "isin", "tradeTime", TIE, "price", "size", spread=SPREAD))


def tick_window_features(spark, folder):
    return _features(spark, folder).select(
        "isin", "tradeTime", *TIE, "delta_t_ms",
        F.round("volume", 2).alias("volume"),
        F.round("target_return", 6).alias("target_return"),
        F.round("vol_sum_10tick", 2).alias("vol_sum_10tick"),
        F.round("vol_sum_50tick", 2).alias("vol_sum_50tick"),
        F.round("price_std_20tick", 4).alias("price_std_20tick"),
    )


def _rolled(rows: DataFrame, period: int, spread: Spread) -> DataFrame:
    return time_window(
        rows, "isin", "tradeTime", period,
        [
            Rolling("current_price", "last", "price"),
            Rolling("max_price", "max", "price"),
            Rolling("volume", "sum", "_volume"),
            Rolling("tick_count", "count"),
        ],
        ["TVTIC"], spread,
    ).withColumn("volume", F.round("volume", 2))


def _with_volume(spark, folder) -> DataFrame:
    rows = ticks(spark, folder)
    return rows.select(
        "isin", "tradeTime", "TVTIC", "price", (F.col("size") * F.col("price")).alias("_volume")
    )


def time_window_past(spark, folder):
    return _rolled(_with_volume(spark, folder), 48 * HOUR, SPREAD).drop("_volume", "price")


def time_window_split(spark, folder):
    """The same with shorter spans for crowded keys: nearly all, at this limit."""
    return _rolled(_with_volume(spark, folder), 60 * HOUR, CROWDED).drop("_volume", "price")


def open_slice_features(spark, folder):
    study = BreakoutStudy(past=6 * HOUR, slice_from=6 * HOUR, slice_to=16 * HOUR, spread=SPREAD)
    return study.past_features(ticks(spark, folder)).withColumn(
        "past_volume", F.round("past_volume", 2)
    )


def asof_backward_nokey(spark, folder):
    rows = ticks(spark, folder).select("isin", "tradeTime", "TVTIC")
    bench = ticks(spark, folder).where(F.col("isin") == BENCHMARK)
    bench = bench.select("tradeTime", "TVTIC", F.col("price").alias("bench_current_price"))
    return asof_join_all(
        rows, Lookup(bench, "tradeTime", ["bench_current_price"], ["TVTIC"]), "tradeTime",
        spread=SPREAD,
    )


def asof_forward_key(spark, folder):
    rows = ticks(spark, folder)
    later = rows.select("isin", "tradeTime", "TVTIC", F.col("price").alias("buy_price"))
    return asof_join(
        rows.select("isin", "tradeTime", "TVTIC"),
        [Lookup(later, "tradeTime", ["buy_price"], ["TVTIC"], 30 * MINUTE)],
        "tradeTime", ["isin"], "forward", spread=SPREAD,
    )


def asof_forward_within(spark, folder):
    rows = ticks(spark, folder)
    later = rows.select("isin", "tradeTime", "TVTIC", F.col("price").alias("buy_price"))
    return asof_join(
        rows.select("isin", "tradeTime", "TVTIC"),
        [Lookup(later, "tradeTime", ["buy_price"], ["TVTIC"], 30 * MINUTE)],
        "tradeTime", ["isin"], "forward", tolerance=12 * HOUR, spread=SPREAD,
    )


def asof_backward_key(spark, folder):
    rows = ticks(spark, folder)
    cancels = rows.where(is_cancel(F.col("flags")))
    cancels = cancels.select("isin", "tradeTime", "TVTIC", F.col("price").alias("cancel_price"))
    return asof_join(
        rows.select("isin", "tradeTime", "TVTIC"),
        [Lookup(cancels, "tradeTime", ["cancel_price"], ["TVTIC"])],
        "tradeTime", ["isin"], "backward", spread=SPREAD,
    )


def benchmark_delta(spark, folder):
    rows = ticks(spark, folder)
    out = labels.with_benchmark_delta(
        rows.select("isin", "tradeTime", "TVTIC"), rows.where(F.col("isin") == BENCHMARK),
        "tradeTime", "price", ["TVTIC"], lambda df: local_date(df, "tradeTime"), SPREAD,
    )
    return out.withColumn("bench_delta", F.round("bench_delta", 6))


def future_target(spark, folder):
    rows = ticks(spark, folder).select("isin", "tradeTime", "TVTIC", "price")
    windows = labels.future_windows(rows, "isin", "tradeTime", "price", 60 * HOUR, ["TVTIC"], SPREAD)
    return labels.with_future(
        rows.select("isin", "tradeTime", "TVTIC"), stage(windows), rows, "isin", "tradeTime",
        "price", 72 * HOUR, 30 * MINUTE, ["TVTIC"], spread=SPREAD,
    )


def _labelled(spark, folder) -> DataFrame:
    rows = ticks(spark, folder)
    return _study().labelled(rows, rows.where(F.col("isin") == BENCHMARK))


def breakout_label(spark, folder):
    return _labelled(spark, folder).select(
        "isin", "tradeTime", "TVTIC", "current_price", "past_max_price",
        F.round("past_volume", 2).alias("past_volume"), "past_tick_count",
        F.round("bench_delta", 6).alias("bench_delta"), "open_time", "future_max_price",
        "sell_price", "buy_price", "target_label",
    )


# --- split, evaluation, report -----------------------------------------------------


def chronological_split(spark, folder):
    """Keys are lots of a security, so that some have too few rows."""
    rows = trades(spark, folder).withColumn("isin", F.col("isin") * 10 + F.floor(F.col("size") / 10))
    rows = rows.select("isin", "tradeTime", *TIE)
    return chrono_split(rows, "isin", "tradeTime", TIE, spread=SPREAD)


def pr_curve(spark, folder):
    curve = evaluate.pr_curve_by_key(
        scored_trades(spark, folder), "isin", "target_label", "score", SPREAD
    )
    return curve.select(
        "isin", "threshold", "hits", "picks", F.round("precision", 6).alias("precision"),
        F.round("recall", 6).alias("recall"),
    )


def auc_by_key(spark, folder):
    found = evaluate.auc_by_key(
        scored_trades(spark, folder), "isin", "target_label", "score", SPREAD
    )
    return found.withColumn("auc", F.round("auc", 6))


def best_fbeta(spark, folder):
    found = evaluate.best_fbeta(
        scored_trades(spark, folder), "isin", "target_label", "score", spread=SPREAD
    )
    return found.withColumns(
        {"precision": F.round("precision", 6), "recall": F.round("recall", 6)}
    )


def _scored_test(spark, folder) -> DataFrame:
    parts = chrono_split(
        scored_trades(spark, folder), "isin", "tradeTime", TIE, spread=SPREAD
    )
    return stage(parts.where("not is_train"))


def signal_returns(spark, folder):
    scored = _scored_test(spark, folder)
    metrics = evaluate.best_fbeta(scored, "isin", "target_label", "score", spread=SPREAD)
    signals = evaluate.trade_signals(scored, metrics, "isin", "score")
    found = evaluate.signal_returns(signals, "isin", local_date(signals, "tradeTime", None))
    return found.withColumn("avg_pnl", F.round("avg_pnl", 4))


def strategy_report(spark, folder):
    study = BreakoutStudy(order=TIE, zone=None, spread=SPREAD)
    return study.report(_scored_test(spark, folder))


def strategy_report_unseen(spark, folder):
    """The report with thresholds from the last fifth of the training rows."""
    parts = chrono_split(
        scored_trades(spark, folder), "isin", "tradeTime", TIE, validation=0.2, spread=SPREAD
    )
    study = BreakoutStudy(order=TIE, zone=None, spread=SPREAD)
    return study.report(stage(parts.where("not is_train or is_validation")), threshold_on="validation")


def most_predictable(spark, folder):
    report = strategy_report(spark, folder)
    return report.select("ISIN", "ROC_AUC_Score").limit(5)


# --- models ------------------------------------------------------------------------


def _lots(spark, folder) -> DataFrame:
    """Lots of a security as keys: about half of them have 100 complete rows."""
    rows = trades(spark, folder).select("isin", "tradeTime", *TIE, "price", "size")
    return rows.withColumn("isin", F.col("isin") * 10 + F.floor(F.col("size") / 13))


def return_training_rows(spark, folder):
    rows = returns.training_rows(_lots(spark, folder), "isin", "tradeTime", TIE, spread=SPREAD)
    return rows.select("isin", "tradeTime", *TIE, "delta_t_ms")


def chosen_return_models(spark, folder):
    """A model of its own for every key with 100 rows: stored, read back, and its fitted values.

    Least-squares trees leave a mean residual of zero, so the means of score and target agree.
    """
    lots = _lots(spark, folder)
    ready = stage(complete_tick_rows(tick_features(lots, "isin", "tradeTime", TIE, "price", "size", spread=SPREAD)))
    path, how = shared_dir(spark), Boosting()
    manifest = returns.fit_every_key(ready, "isin", path, how=how)
    saved = load_models(spark, path, "isin")
    scored = score_by_key(ready, saved, "isin", RETURN_FEATURES, how).groupBy("isin").agg(
        F.count(F.lit(1)).alias("scored"), F.round(F.avg("score"), 6).alias("mean_score")
    )
    return manifest.join(scored, "isin", "left").select(
        "isin", "rows", "rounds", "status", F.coalesce("scored", F.lit(0)).alias("scored"), "mean_score"
    )


def return_model(spark, folder):
    """Pooled next-tick model, 100 rounds: least-squares trees keep the mean of the target."""
    rows = trades(spark, folder).select("isin", "tradeTime", *TIE, "price", "size")
    ready = stage(returns.training_rows(rows, "isin", "tradeTime", TIE, spread=SPREAD))
    _, scored = returns.fit_and_score(ready)
    everything = Window.partitionBy()
    by_key = scored.groupBy("isin").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("score").alias("score_sum"),
        F.round(F.stddev_pop("target_return"), 6).alias("rmse_of_mean"),
    )
    # One row per key here; the mean is over all keys, as the fit is.
    mean = F.sum("score_sum").over(everything) / F.sum("rows").over(everything)
    return by_key.select("isin", "rows", "rmse_of_mean", F.round(mean, 6).alias("mean_score"))


def _user_groups(spark, folder) -> DataFrame:
    """Labelled rows by groups of users, each twice as large as the one before."""
    rows = ticks(spark, folder).withColumn("isin", F.length(F.bin(F.col("isin") + 1)).cast("bigint"))
    return stage(_study().labelled(rows, rows.where(F.col("isin") == BENCHMARK)))


def breakout_model(spark, folder):
    """The whole study: labels, a model per key with early stopping, the report of all keys."""
    study = _study()
    _, scored = study.fit_every_key(_user_groups(spark, folder), shared_dir(spark))
    return study.report(scored)


def breakout_by_key(spark, folder):
    """Which keys got a model, and the test rows it scored."""
    manifest, scored = _study().fit_every_key(_user_groups(spark, folder), shared_dir(spark))
    tested = scored.groupBy("isin").agg(
        F.count("score").alias("test_rows"), F.sum("target_label").alias("test_breakouts")
    )
    fitted = F.col("status").isin("saved", "rejected")
    joined = manifest.select("isin", "rows", fitted.alias("is_fitted")).join(tested, "isin", "left")
    return joined.fillna(0, ["test_rows", "test_breakouts"])


QUERIES = {
    f.__name__: f
    for f in [
        dedupe_keep_last, dedupe_per_source, latest_name, union_drift, duplicate_profile,
        flag_profile, cancelled_pairs, split_executions, consolidate_signed, consolidated_small,
        consolidated_large, time_bound, daily_activity, universe_any_day, universe_enough_days,
        prev_trading_day, trading_days_by_month, coverage_report, missing_by_month,
        coverage_counts, last_day_position, files_chosen, sources_with_names, unreadable_files,
        first_file_rows, file_date_audit, file_audit_summary, file_majority_date,
        file_majority_of_head, ingest_quoted, ingest_unquoted,
        ingest_security_names, stored_by_day, report_file, tick_window_features, time_window_past, time_window_split,
        open_slice_features, asof_backward_nokey, asof_forward_key, asof_forward_within,
        asof_backward_key, benchmark_delta, future_target, breakout_label, chronological_split,
        pr_curve, auc_by_key, best_fbeta, signal_returns, strategy_report,
        strategy_report_unseen, most_predictable,
        return_training_rows, chosen_return_models, return_model, breakout_model,
        breakout_by_key,
    ]
}
