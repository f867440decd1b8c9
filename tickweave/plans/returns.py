"""The next-tick return study: features, row gate, training and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.boosting import Boosting, fit_rounds, models
from ..operators.model_store import load_manifest, save_models
from ..operators.models import RETURN_FEATURES, PooledTrees, fit_return_model, score_rows
from ..operators.spread import DEFAULT, Spread
from ..operators.tick_window import complete_tick_rows, tick_features
from ..session import broadcast_if_small, stage


def training_rows(
    ticks: DataFrame, key: str, ts: str, order: Sequence[str], price: str = "price",
    size: str = "size", min_rows: int = 100, spread: Spread = DEFAULT,
) -> DataFrame:
    """Complete feature rows of keys that have at least ``min_rows`` of them."""
    rows = stage(
        complete_tick_rows(tick_features(ticks, key, ts, order, price, size, spread=spread))
    )
    enough = rows.groupBy(key).count().where(F.col("count") >= min_rows).select(key)
    return rows.join(broadcast_if_small(enough), key, "left_semi")


def fit_and_score(rows: DataFrame, rounds: int = 100) -> tuple[PooledTrees, DataFrame]:
    """A pooled model on ``rows`` (a stored table) and its fitted values."""
    model = fit_return_model(rows, RETURN_FEATURES, "target_return", rounds)
    return model, score_rows(model, rows)


def fit_every_key(
    rows: DataFrame, key: str, path: str, min_rows: int = 100, how: Boosting = Boosting(),
) -> DataFrame:
    """A model of its own for every security of ``rows`` (a stored table of complete rows).

    Models go to the store at ``path``. One manifest row per security comes back: rows, rounds,
    status (saved, skipped for too few rows, or failed) and the reason of a failure.
    """
    counts = stage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")))
    enough = counts.where(F.col("rows") >= min_rows).select(key)
    known, rounds = fit_rounds(
        rows.join(enough, key, "left_semi"), key, RETURN_FEATURES, "target_return", how=how
    )
    fitted = models(known, rounds, key, how)
    found = counts.join(fitted.select(key, F.col("round").alias("rounds")), key, "left")
    found = found.join(rounds.where("error is not null").select(key, "error"), key, "left")
    status = (
        F.when(F.col("rows") < min_rows, "skipped").when(F.col("error").isNotNull(), "failed").otherwise("saved")
    )
    verdict = stage(found.withColumn("status", status).fillna(0, ["rounds"]))
    run = save_models(fitted, verdict, path, key)
    return load_manifest(counts.sparkSession, path).where(F.col("run_id") == run).drop("run_id")
