"""Pooled boosted trees: one model for all securities, trained on all executors.

The breakout model is one of Spark ML. The return model grows the trees of ``boosting``, with all
rows as one security: its blocks hold bins of one byte, and a level is one short job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .boosting import Boosting, fit_rounds, forest, forest_score, models

# Inputs of the two studies.
RETURN_FEATURES = [
    "price", "volume", "delta_t_ms", "vol_sum_10tick", "vol_sum_50tick", "price_std_20tick",
]
BREAKOUT_FEATURES = [
    "current_price", "past_max_price", "past_volume", "past_tick_count", "bench_delta",
]


@dataclass(frozen=True)
class PooledTrees:
    """Trees of all rows: ``fitted`` has one row with base, edges and trees."""

    fitted: DataFrame
    features: tuple[str, ...]
    how: Boosting

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``score``; the model, of bounded size, goes to every task."""
        model, how = self.fitted.toArrow(), self.how
        edges, base = model.column("edges")[0].as_py(), model.column("base")[0].as_py()
        trees = forest(model.column("trees").combine_chunks().flatten())

        @F.arrow_udf("double")
        def score(*columns: pa.Array) -> pa.Array:
            values = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]
            return pa.array(forest_score(values, edges, base, trees, how))

        return df.withColumn("score", score(*(F.col(c).cast("double") for c in self.features)))


def fit_return_model(
    train: DataFrame, features: Sequence[str], label: str, rounds: int = 100,
    step: float = 0.05, depth: int = 5, block_rows: int = 200_000,
) -> PooledTrees:
    """Squared-error boosting; depth 5 allows up to 32 leaves per tree.

    ``train`` is read twice: pass a stored table. More than ``block_rows`` rows are fitted in blocks.
    """
    how = Boosting(rounds=rounds, step=step, depth=depth, min_leaf=1, block_rows=block_rows)
    pool = train.select(F.lit(0).alias("_pool"), *dict.fromkeys([*features, label]))
    known, grown = fit_rounds(pool, "_pool", features, label, how=how)
    fitted = stage(models(known, grown, "_pool", how))
    if fitted.isEmpty():
        raise ValueError("no rows to learn from, or labels that are not all finite numbers")
    return PooledTrees(fitted, tuple(features), how)


def fit_breakout_model(
    train: DataFrame, features: Sequence[str], label: str, validation: str | None = None,
    rounds: int = 200, step: float = 0.05, depth: int = 5, seed: int = 7,
) -> PipelineModel:
    """Log-loss boosting that stops early on the rows marked by ``validation``."""
    booster = GBTClassifier(
        featuresCol="_features", labelCol=label, maxIter=rounds, stepSize=step,
        maxDepth=depth, seed=seed, checkpointInterval=10,
    )
    if validation:
        booster = booster.setValidationIndicatorCol(validation)
    return _fit(train, features, booster)


def _fit(train: DataFrame, features: Sequence[str], booster) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    return Pipeline(stages=[assembler, booster]).fit(train)


def score_rows(model: PipelineModel | PooledTrees, df: DataFrame) -> DataFrame:
    """Add ``score``: the predicted value, or the probability of class 1."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("score", vector_to_array("probability")[1])
    return out.select(*df.columns, "score")


def save_model(model: PipelineModel | PooledTrees, path: str) -> str:
    if isinstance(model, PooledTrees):
        model.fitted.write.mode("overwrite").parquet(path)
        return path
    model.write().overwrite().save(path)
    return path
