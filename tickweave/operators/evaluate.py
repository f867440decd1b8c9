"""Per-security evaluation of scored rows and the strategy report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.cells import number_text, percent_text
from ..session import broadcast_if_small
from .spread import DEFAULT, Spread, running_totals


def pr_curve_by_key(
    scored: DataFrame, key: str, label: str, score: str, spread: Spread = DEFAULT
) -> DataFrame:
    """Hits and picks at each distinct score taken as threshold, per key.

    Rows combine per (key, score) before the shuffle; running sums then go from
    the highest score down.
    """
    steps = (
        scored.groupBy(key, F.col(score).alias("threshold"))
        .agg(F.sum(label).alias("_pos"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_down", -F.col("threshold"))
    )
    run = running_totals(
        steps, [key], "_down", [F.col("_down")], {"hits": F.col("_pos"), "picks": F.col("_n")}, spread
    )
    return run.select(
        key,
        "threshold",
        F.col("_pos").alias("step_hits"),
        (F.col("_n") - F.col("_pos")).alias("step_misses"),
        "hits",
        "picks",
        F.col("hits_total").alias("positives"),
        F.col("picks_total").alias("rows"),
        F.try_divide("hits", "picks").alias("precision"),
        F.try_divide("hits", "hits_total").alias("recall"),
    )


def metrics_by_key(
    curve: DataFrame, key: str, beta: float = 0.5, limits: DataFrame | None = None
) -> DataFrame:
    """ROC AUC and the threshold with the best F-beta, one row per key.

    AUC counts, for each miss, the hits scored above it, ties half. The best
    threshold is the lowest one among equals. A key whose rows are all of one
    class gets 0 for all measures and threshold 0.5.

    ``limits`` (a stored table of key and threshold) holds thresholds that were chosen on
    other rows. Precision and recall are then those at this threshold, 0.5 for a key
    it does not hold, and 0 where nothing reaches it or nothing is to be found.
    """
    weight = beta * beta
    fbeta = F.coalesce(
        F.try_divide(
            (1 + weight) * F.col("precision") * F.col("recall"),
            weight * F.col("precision") + F.col("recall"),
        ),
        F.lit(0.0),
    )
    above = F.col("hits") - F.col("step_hits")
    area = F.sum(F.col("step_misses") * (above + F.col("step_hits") / 2))
    best = F.max_by(
        F.struct("threshold", "precision", "recall"), F.struct(fbeta, -F.col("threshold"))
    )
    if limits is not None:
        given = limits.select(key, F.col("threshold").alias("_limit"))
        curve = curve.join(broadcast_if_small(given, is_stored=True), key, "left").fillna(0.5, ["_limit"])
        reached = F.when(F.col("threshold") >= F.col("_limit"), F.col("threshold"))
        best = F.struct(
            F.max("_limit").alias("threshold"),
            F.coalesce(F.min_by("precision", reached), F.lit(0.0)).alias("precision"),
            F.coalesce(F.min_by("recall", reached), F.lit(0.0)).alias("recall"),
        )
    found = curve.groupBy(key).agg(
        F.max("rows").alias("rows"),
        F.max("positives").alias("positives"),
        area.alias("_area"),
        best.alias("_best"),
    )
    mixed = (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    # As doubles: the product of two large counts does not fit a bigint.
    pairs = F.col("positives").cast("double") * (F.col("rows") - F.col("positives"))

    def when_mixed(value, other: float):
        return F.when(mixed, value).otherwise(F.lit(other))

    auc = when_mixed(F.try_divide(F.col("_area"), pairs), 0.0).alias("auc")
    if limits is not None:
        return found.select(key, "rows", "positives", auc, "_best.*")
    return found.select(
        key, "rows", "positives",
        auc,
        when_mixed(F.col("_best.threshold"), 0.5).alias("threshold"),
        when_mixed(F.col("_best.precision"), 0.0).alias("precision"),
        when_mixed(F.col("_best.recall"), 0.0).alias("recall"),
    )


def auc_by_key(
    scored: DataFrame, key: str, label: str, score: str, spread: Spread = DEFAULT
) -> DataFrame:
    return metrics_by_key(pr_curve_by_key(scored, key, label, score, spread), key).select(key, "auc")


def best_fbeta(
    scored: DataFrame, key: str, label: str, score: str, beta: float = 0.5, spread: Spread = DEFAULT
) -> DataFrame:
    curve = pr_curve_by_key(scored, key, label, score, spread)
    return metrics_by_key(curve, key, beta).select(key, "threshold", "precision", "recall")


def trade_signals(
    scored: DataFrame, metrics: DataFrame, key: str, score: str, is_stored: bool = False
) -> DataFrame:
    """Rows whose score reaches the threshold of their key."""
    limits = broadcast_if_small(metrics.select(key, "threshold"), is_stored=is_stored)
    return scored.join(limits, key).where(F.col(score) >= F.col("threshold"))


def signal_returns(
    signals: DataFrame, key: str, day, buy: str = "buy_price", sell: str = "sell_price"
) -> DataFrame:
    """Mean return in percent and the dates of the signals, one row per key.

    Rows first combine per (key, day), so the date list of a key is no longer
    than the calendar.
    """
    gain = F.try_divide(F.col(sell) - F.col(buy), F.col(buy)) * 100
    daily = signals.groupBy(key, day.alias("_day")).agg(
        F.sum(gain).alias("_gain"), F.count(gain).alias("_n")
    )
    dates = F.array_sort(F.collect_list(F.date_format("_day", "yyyy-MM-dd")))
    return daily.groupBy(key).agg(
        F.try_divide(F.sum("_gain"), F.sum("_n")).alias("avg_pnl"),
        F.array_join(dates, " | ").alias("signal_dates"),
    )


def strategy_report(
    metrics: DataFrame, returns: DataFrame, totals: DataFrame, key: str
) -> DataFrame:
    """The ranked report: one row per key, best AUC first.

    ``totals`` has ``total_rows`` per key (train and test together).
    """
    joined = metrics.join(returns, key, "left").join(totals, key, "left")
    return joined.select(
        F.col(key).alias("ISIN"),
        F.col("total_rows").alias("Total_Ticks"),
        F.col("rows").alias("Test_Set_Ticks"),
        F.col("positives").alias("Actual_Breakouts_In_Test"),
        percent_text(F.coalesce(F.try_divide("positives", "rows"), F.lit(0.0))).alias(
            "Base_Breakout_Frequency"
        ),
        number_text(F.col("threshold")).alias("Optimal_Threshold"),
        percent_text(F.col("precision")).alias("Model_Precision (F0.5)"),
        percent_text(F.col("recall")).alias("Model_Recall"),
        F.bround("auc", 4).alias("ROC_AUC_Score"),
        F.bround(F.coalesce("avg_pnl", F.lit(0.0)), 2).alias("Test_Set_Avg_PnL_Percent"),
        F.coalesce("signal_dates", F.lit("None")).alias("Signal_Dates"),
    ).orderBy(F.desc("ROC_AUC_Score"), "ISIN")
