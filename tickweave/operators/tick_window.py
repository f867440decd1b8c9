"""Features over a fixed number of ticks per security."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import micros, millis_between
from .dedupe import drop_nulls
from .spread import BIN, DEFAULT, SEED, Spread, with_neighbour_rows



def tick_features(
    df: DataFrame, key: str, ts: str, order: Sequence[str], price: str, size: str,
    sums: Sequence[int] = (10, 50), std: int = 20, spread: Spread = DEFAULT,
) -> DataFrame:
    """Traded value, time since the last tick, return to the next tick, and
    rolling sums and deviation that stay null until their window is full.

    All frames reach back a fixed number of rows, so a large security is cut
    into bins that overlap by that many rows.
    """
    reach = max([*sums, std]) - 1
    based = df.withColumn("volume", F.col(size) * F.col(price)).withColumn("_t", micros(df, ts))
    rows = with_neighbour_rows(based, [key], "_t", order, reach, 1, spread)
    ordered = Window.partitionBy(key, BIN).orderBy("_t", *order)

    def rolling(function, source: str, n: int) -> Column:
        frame = ordered.rowsBetween(-(n - 1), 0)
        return F.when(F.count(source).over(frame) >= n, function(source).over(frame))

    following = F.lead(price).over(ordered)
    out = rows.select(
        *df.columns,
        "volume",
        SEED,
        millis_between(F.col("_t"), F.lag("_t").over(ordered)).alias("delta_t_ms"),
        F.try_divide(following - F.col(price), F.col(price)).alias("target_return"),
        *[rolling(F.sum, "volume", n).alias(f"vol_sum_{n}tick") for n in sums],
        rolling(F.stddev_samp, price, std).alias(f"price_std_{std}tick"),
    )
    return out.where(F.col(SEED) == 0).drop(SEED)


def complete_tick_rows(features: DataFrame) -> DataFrame:
    """Rows a model can use: next price, last gap and full windows all known."""
    return drop_nulls(
        features, ["target_return", "delta_t_ms", "vol_sum_50tick", "price_std_20tick"]
    )
