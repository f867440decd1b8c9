"""Row gate and chronological split per security."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.times import micros
from .spread import DEFAULT, Spread, running_totals


def chrono_split(
    df: DataFrame, key: str, ts: str, order: Sequence[str], share: float = 0.8,
    min_rows: int = 100, validation: float | None = None, spread: Spread = DEFAULT,
) -> DataFrame:
    """Add ``total_rows`` and ``is_train``; keys below ``min_rows`` are left out.

    The first ``int(total * share)`` rows in time order train, the rest test.
    ``validation`` adds ``is_validation``: that last share of the train rows,
    for early stopping without a look at the test rows.
    """
    placed = running_totals(
        df.withColumn("_t", micros(df, ts)),
        [key], "_t", [F.col("_t"), *[F.col(c) for c in order]], {"_place": F.lit(1)}, spread, order,
    )
    cut = F.floor(F.col("_place_total") * F.lit(share))
    extra = []
    if validation is not None:
        late = F.col("_place") > F.floor(cut * F.lit(1 - validation))
        extra.append(((F.col("_place") <= cut) & late).alias("is_validation"))
    return placed.where(F.col("_place_total") >= min_rows).select(
        *df.columns,
        F.col("_place_total").alias("total_rows"),
        (F.col("_place") <= cut).alias("is_train"),
        *extra,
    )
