"""The breakout study: features, labels, split, training and report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.times import EXCHANGE_ZONE, HOUR, MINUTE, local_date
from ..operators.evaluate import (
    auc_by_key, metrics_by_key, pr_curve_by_key, signal_returns, strategy_report, trade_signals,
)
from ..operators.labels import breakout_label, future_windows, with_benchmark_delta, with_future
from ..operators.boosting import Boosting, fit_rounds, models, score_by_key
from ..operators.model_store import load_manifest, save_models
from ..operators.models import BREAKOUT_FEATURES, fit_breakout_model, score_rows
from ..operators.spread import DEFAULT, Spread, parted_by_size
from ..operators.split import chrono_split
from ..operators.time_window import Rolling, after_open, open_times, time_window
from ..session import stage

#: At most 200 rounds, stopped 10 rounds after the least validation loss.
BREAKOUT_TREES = Boosting(rounds=200, logistic=True, patience=10)


@dataclass(frozen=True)
class BreakoutStudy:
    """Names, durations in microseconds, and when large groups are cut."""

    key: str = "isin"
    ts: str = "tradeTime"
    price: str = "price"
    size: str = "size"
    order: Sequence[str] = ("TVTIC",)
    past: int = 2 * HOUR
    slice_from: int = 2 * HOUR
    slice_to: int = 4 * HOUR
    future: int = 2 * HOUR + 30 * MINUTE
    horizon: int = 3 * HOUR
    delay: int = 30 * MINUTE
    factor: float = 1.005
    tolerance: int | None = None
    zone: str | None = EXCHANGE_ZONE
    spread: Spread = DEFAULT

    def past_features(self, ticks: DataFrame) -> DataFrame:
        """Rolling past features of the rows in the slice after the open.

        A window of such a row starts after the open when the slice starts no
        earlier than the window is long; then only the rows up to the slice's
        end take part, and no window leaves its day: open time and windows come from one shuffle by
        (security, day). Days too large for one task, and all days where windows
        reach further back, get their open time by a join, and spans of their own.
        """
        dated = ticks.withColumns(
            {
                "trade_day": local_date(ticks, self.ts, self.zone),
                "_volume": F.col(self.size) * F.col(self.price),
            }
        )
        if self.slice_from < self.past:
            return self._slice(self._rolled(self._opened(dated)))
        whole, large = parted_by_size(dated, [self.key, "trade_day"], self.spread)
        whole = whole.where(F.col(self.key).isNotNull() & F.col("trade_day").isNotNull())
        day = Window.partitionBy(self.key, "trade_day")
        opened = self._first_hours(whole.withColumn("open_time", F.min(self.ts).over(day)))
        found = self._slice(self._rolled(opened, ["trade_day"]))
        if large is None:
            return found
        return found.unionByName(self._slice(self._rolled(self._first_hours(self._opened(large)))))

    def _opened(self, dated: DataFrame) -> DataFrame:
        return dated.join(open_times(dated, self.key, "trade_day", self.ts), [self.key, "trade_day"])

    def _first_hours(self, opened: DataFrame) -> DataFrame:
        return after_open(opened, self.ts, "open_time", 0, self.slice_to)

    def _rolled(self, opened: DataFrame, within: Sequence[str] = ()) -> DataFrame:
        return time_window(
            opened, self.key, self.ts, self.past,
            [
                Rolling("current_price", "last", self.price),
                Rolling("past_max_price", "max", self.price),
                Rolling("past_volume", "sum", "_volume"),
                Rolling("past_tick_count", "count"),
            ],
            list(self.order), self.spread, within,
        )

    def _slice(self, rolled: DataFrame) -> DataFrame:
        sliced = after_open(rolled, self.ts, "open_time", self.slice_from, self.slice_to)
        return sliced.select(
            self.key, self.ts, *self.order, "current_price", "past_max_price", "past_volume",
            "past_tick_count", "open_time",
        )

    def labelled(self, ticks: DataFrame, benchmark: DataFrame) -> DataFrame:
        """Features, future prices and the label. ``ticks`` is read several
        times: pass a stored table. Both window results are stored, since the
        as-of joins scan them more than once."""
        order = list(self.order)
        past = stage(self.past_features(ticks))
        with_delta = with_benchmark_delta(
            past, benchmark, self.ts, self.price, order,
            lambda df: local_date(df, self.ts, self.zone), self.spread,
        )
        narrow = ticks.select(self.key, self.ts, *order, self.price)
        future = future_windows(
            narrow, self.key, self.ts, self.price, self.future, order, self.spread
        )
        joined = with_future(
            with_delta, stage(future), narrow, self.key, self.ts, self.price, self.horizon,
            self.delay, order, self.tolerance, self.spread,
        )
        return breakout_label(joined, "future_max_price", "past_max_price", self.factor)

    def train_and_score(
        self, labelled: DataFrame, rounds: int = 200, min_rows: int = 100, validation: float = 0.2
    ) -> DataFrame:
        """Test rows with their score; ``labelled`` should be a stored table."""
        parts = chrono_split(
            labelled, self.key, self.ts, list(self.order), 0.8, min_rows, validation, self.spread
        )
        parts = stage(parts)
        model = fit_breakout_model(
            parts.where("is_train"), BREAKOUT_FEATURES, "target_label", "is_validation", rounds
        )
        return score_rows(model, parts.where("not is_train"))

    def fit_every_key(
        self, labelled: DataFrame, path: str, how: Boosting = BREAKOUT_TREES, min_rows: int = 100,
        min_auc: float = 0.55, validation: float = 0.2, score_validation: bool = False,
    ) -> tuple[DataFrame, DataFrame]:
        """A model of its own for every security of ``labelled`` (a stored table).

        Returns the manifest rows of this run and the scored test rows. A model is saved in the
        store at ``path`` if its test AUC reaches ``min_auc``; otherwise the status is
        rejected, skipped (too few rows) or failed, with the reason. With ``score_validation``
        the scored rows also hold the validation rows, for :meth:`report` to choose thresholds on.
        """
        key = self.key
        counts = stage(labelled.groupBy(key).agg(F.count(F.lit(1)).alias("rows")))
        parts = stage(
            chrono_split(
                labelled, key, self.ts, list(self.order), 0.8, min_rows, validation, self.spread
            )
        )
        known, rounds = fit_rounds(
            parts.where("is_train"), key, BREAKOUT_FEATURES, "target_label", "is_validation", how
        )
        fitted = stage(models(known, rounds, key, how))
        wanted = "not is_train or is_validation" if score_validation else "not is_train"
        scored = stage(score_by_key(parts.where(wanted), fitted, key, BREAKOUT_FEATURES, how))
        tested = scored.where("not is_train")
        found = (
            counts.join(auc_by_key(tested, key, "target_label", "score", self.spread), key, "left")
            .join(fitted.select(key, "round", "run"), key, "left")
            .join(rounds.where("error is not null").select(key, "error"), key, "left")
        )
        status = (
            F.when(F.col("rows") < min_rows, "skipped")
            .when(F.col("error").isNotNull(), "failed")
            .when(F.col("auc") >= min_auc, "saved")
            .otherwise("rejected")
        )
        verdict = stage(found.withColumn("status", status))
        run = save_models(fitted, verdict, path, key)
        manifest = load_manifest(labelled.sparkSession, path).where(F.col("run_id") == run)
        return manifest.drop("run_id"), scored

    def report(self, scored: DataFrame, beta: float = 0.5, threshold_on: str = "test") -> DataFrame:
        """Ranked strategy report from scored test rows (a stored table).

        ``threshold_on='validation'`` takes the thresholds from the rows with
        ``is_validation``, so that no test row has a say in them; such rows count nowhere else.
        """
        if threshold_on not in ("test", "validation"):
            raise ValueError(f"threshold_on is 'test' or 'validation', not {threshold_on!r}")

        def curve_of(rows: DataFrame) -> DataFrame:
            return pr_curve_by_key(rows, self.key, "target_label", "score", self.spread)

        limits = None
        if threshold_on == "validation":
            chosen = metrics_by_key(curve_of(scored.where("is_validation")), self.key, beta)
            limits = stage(chosen.select(self.key, "threshold"))
        if "is_validation" in scored.columns:
            scored = scored.where("not is_validation")
        metrics = stage(metrics_by_key(curve_of(scored), self.key, beta, limits))
        signals = trade_signals(scored, metrics, self.key, "score", is_stored=True)
        returns = signal_returns(signals, self.key, local_date(signals, self.ts, self.zone))
        totals = scored.groupBy(self.key).agg(F.max("total_rows").alias("total_rows"))
        return strategy_report(metrics, returns, totals, self.key)
