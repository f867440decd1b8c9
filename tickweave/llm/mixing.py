"""Mixing sources to target weights by systematic sampling.

Every source has a share of all words. A row's expected copies are its source's
target over its source's size. The expected copies are summed along the rows of
a source, shifted by one random offset, and a row is taken once for every whole
number that the sum crosses at it.

Defined results: a null text or one without words has size 0 and may be taken,
adding nothing. A null source is a source of its own, ranked last. A source of
size 0 has target 0 and is not taken. Repeated rows are separate rows; equal rows
may swap their counts. An empty table gives an empty result. Further columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .common import col, fresh, hash32, prefix, word_count

#: Expected copies are whole multiples of this part, so that sums are exact.
PARTS = 10**12
BIG = "decimal(38,0)"


def source_targets(
    rows: DataFrame, source: Column, size: Column, weights: Sequence[int] = (1, 2, 3), cap: int = 3
) -> DataFrame:
    """One row per source: n_rows, source_size, target, expected (in ``PARTS``).

    Sources, by code point with null last, weigh ``weights`` in turn and share the
    total. A target stops at ``cap`` times the source's size; what is over goes to
    the others by weight. The stopped sources are those with the least size per
    weight, so one running sum in that order finds them. The windows run over one
    row per source.
    """
    sums = rows.groupBy(source.alias("source")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("source_size")
    )
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weighed = sums.withColumn("rank", turn).withColumn(
        "weight",
        F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")),
    )
    all_rows = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") * cap / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full = F.col("source_size").cast(BIG) * cap
    left = F.sum("source_size").over(all_rows).cast(BIG) - F.coalesce(
        F.sum(F.col("source_size") * cap).over(before), F.lit(0)
    ).cast(BIG)
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    stopped = weighed.withColumn("left", left).withColumn("weight_left", weight_left).withColumn(
        "stopped", full * F.col("weight_left").cast(BIG) < F.col("left") * F.col("weight").cast(BIG)
    )
    # The first source that is not stopped sets the level for all that follow it.
    level = F.min(F.when(~F.col("stopped"), F.struct("rank_by_size", "left", "weight_left"))).over(all_rows)
    shared = (
        stopped.withColumn("rank_by_size", F.row_number().over(order))
        .withColumn("level", level)
        .withColumn(
            "target",
            F.when(F.col("stopped"), full.cast("double")).otherwise(
                F.col("level.left").cast("double")
                * F.col("weight").cast("double")
                / F.col("level.weight_left").cast("double")
            ),
        )
    )
    return shared.select(
        "source",
        "n_rows",
        "source_size",
        "target",
        F.when(
            F.col("source_size") > 0,
            F.round(F.col("target") / F.col("source_size").cast("double") * PARTS).cast(BIG),
        )
        .otherwise(F.lit(0).cast(BIG))
        .alias("expected"),
    )


def systematic_mix(
    rows: DataFrame,
    targets: DataFrame,
    source: Column,
    size: Column,
    key: Column,
    out: str = "mix",
    seed: int = 1,
    rows_per_bin: int = 2_000,
) -> DataFrame:
    """``rows`` with a struct column ``out`` (size, source_size, target, copies).

    A source of any length is cut into bins of about ``rows_per_bin`` rows by a hash of
    ``key``. A bin starts at the sum of the bins before it, taken from one row per
    bin, so no task holds a source. Inside a bin rows go by size, which keeps the
    words taken close to the target.
    """
    p = prefix(rows, "mix_")
    of = targets.select(*(F.col(c).alias(p + c) for c in targets.columns))
    bin_ = F.pmod(hash32(F.lit(seed), F.col(p + "key")), F.ceil(F.col(p + "n_rows") / rows_per_bin))

    def binned(df: DataFrame) -> DataFrame:
        joined = df.join(of, F.col(p + "from").eqNullSafe(F.col(p + "source")))
        return joined.withColumn(p + "bin", bin_.cast("long"))

    totals = (
        binned(rows.select(source.alias(p + "from"), key.alias(p + "key")))
        .groupBy(F.col(p + "source").alias(p + "s"), F.col(p + "bin").alias(p + "b"))
        .agg(F.sum(p + "expected").cast(BIG).alias(p + "total"))
    )
    earlier = Window.partitionBy(p + "s").orderBy(p + "b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn(
        p + "start", F.coalesce(F.sum(p + "total").over(earlier), F.lit(0)).cast(BIG)
    )
    running = (
        Window.partitionBy(p + "source", p + "bin")
        .orderBy(p + "size", p + "key")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    offset = hash32(F.lit(seed), F.lit("offset"), F.col(p + "source")) % 1_000_000 * 1_000_000
    placed = (
        binned(
            rows.withColumns({p + "from": source, p + "key": key, p + "size": size})
        )
        .withColumn(p + "here", F.sum(p + "expected").over(running).cast(BIG))
        .join(
            starts,
            F.col(p + "source").eqNullSafe(F.col(p + "s")) & (F.col(p + "bin") == F.col(p + "b")),
        )
        .withColumn(p + "end", (F.col(p + "start") + F.col(p + "here") + offset).cast(BIG))
        .withColumn(p + "begin", (F.col(p + "end") - F.col(p + "expected")).cast(BIG))
    )
    copies = F.expr(f"{p}end div {PARTS}BD - {p}begin div {PARTS}BD")
    return placed.select(
        *(col(c) for c in rows.columns),
        F.struct(
            F.col(p + "size").alias("size"),
            F.col(p + "source_size").alias("source_size"),
            F.col(p + "target").alias("target"),
            copies.cast("long").alias("copies"),
        ).alias(out),
    )


def mixed_rows(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    seed: int = 1,
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, same columns."""
    (mix,) = fresh(docs, "mix")
    (turn,) = fresh(docs, "mix_turn")
    size = word_count(col(text))
    targets = stage(source_targets(docs, col(source), size, weights, cap))
    found = systematic_mix(docs, targets, col(source), size, col(key), mix, seed)
    taken = found.where(F.col(mix)["copies"] > 0).withColumn(
        turn, F.explode(F.sequence(F.lit(1), F.col(mix)["copies"]))
    )
    return taken.select(*(col(c) for c in docs.columns))
