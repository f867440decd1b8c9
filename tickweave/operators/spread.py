"""Ordered work per group when one group may hold a third of all rows.

A window partitioned by the group alone would put such a group into one task.
Here the sizes of groups that a sample shows as large are measured first, and only the
largest groups are cut into bins along their ordering axis, and along the columns that
decide ties where many rows share one instant; the rows every bin must know from its
neighbours arrive as a few *seed* rows. All other groups stay whole, and each
row is still shuffled exactly once.

What is collected and broadcast has a proven bound: ``max_groups`` rows. Longer lists of
groups to cut stay a table and are joined by a shuffle; no group is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

BIN = "_bin"
HOT = "_hot"
SEED = "_seed"
RECUT = 16
LOOKS = 2_000
PICKS = 1_024
TIE_PARTS = 64


@dataclass(frozen=True)
class Spread:
    """When a group is cut, how fine, and how long a list of cuts may be broadcast."""

    min_rows: int = 2_000_000
    rows_per_bin: int = 1_000_000
    max_groups: int = 10_000


DEFAULT = Spread()


def with_bins(
    df: DataFrame, by: Sequence[str], axis: str, spread: Spread = DEFAULT, ties: Sequence[str] = ()
) -> DataFrame:
    """Add ``_bin`` (rises with ``axis`` within a group) and ``_hot``.

    A large group gets bins of equal width, ``rows_per_bin`` rows on average. A
    bin that came out more than twice as full, because many rows lie close
    together, is cut again between its own lowest and highest value, and then
    finer, to be done in few rounds, until no bin is too full or only rows equal on
    ``axis`` are left in it. Each
    round is one aggregation, after the first one over the rows of large groups
    only; without a large group there is no second. Rows without a value on
    ``axis`` come first.

    ``ties`` names the columns that order rows equal on ``axis`` (ascending, nulls
    first). With them, bins that are still too full are cut along these columns, and
    only rows equal in all of them stay together. ``_bin`` is then an array.
    """
    by = list(by)
    out = df.withColumns({BIN: F.lit(0.0), HOT: F.lit(False)})
    rows = of_likely_large(out, by, spread)
    if rows is not None:
        limit = spread.min_rows
        for level in count():
            sizes = (out.where(HOT) if level else rows).groupBy(*by, BIN).agg(
                F.count(F.lit(1)).alias("_n"),
                F.min(F.col(axis).cast("double")).alias("_lo"),
                F.max(F.col(axis).cast("double")).alias("_hi"),
            )
            wide = F.col("_lo") < F.col("_hi")
            # The first round also marks groups that lie on one instant, for the cut along ties.
            chosen = F.lit(True) if ties and not level else wide
            cuts = bounded_table(sizes.where((F.col("_n") >= limit) & chosen), spread.max_groups)
            if cuts is None:
                break
            rows_per_bin = spread.rows_per_bin / (RECUT if level else 1)
            out = _cut(out, cuts, by, axis, rows_per_bin)
            limit = 2 * spread.rows_per_bin
    return _cut_ties(out, by, [axis, *ties], spread) if ties else out


def of_likely_large(df: DataFrame, by: list[str], spread: Spread) -> DataFrame | None:
    """Rows of the groups that may reach ``min_rows``; None if there is none.

    A sample shows them, so that counts of all the small groups are never shuffled. A
    group of ``min_rows`` rows is expected ``LOOKS`` times in it and a candidate from half
    of that on: the chance to miss it is below 1e-100, and results would still
    be right. Candidates are counted exactly afterwards.
    """
    rate = LOOKS / spread.min_rows
    if rate >= 1:
        return df
    seen = df.sample(rate, seed=LOOKS).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    likely = seen.where(F.col("_n") >= LOOKS / 2).select(*[F.col(k).alias(f"_r_{k}") for k in by])
    found = bounded_table(likely, spread.max_groups)
    return None if found is None else df.join(found, _same(df, found, by), "left_semi")


def parted_by_size(
    df: DataFrame, by: Sequence[str], spread: Spread = DEFAULT
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the groups below ``min_rows``, and those of the larger ones (None if there is none)."""
    by = list(by)
    rows = of_likely_large(df, by, spread)
    if rows is None:
        return df, None
    sizes = rows.groupBy(*[F.col(k).alias(f"_r_{k}") for k in by]).agg(F.count(F.lit(1)).alias("_n"))
    large = bounded_table(sizes.where(F.col("_n") >= spread.min_rows).drop("_n"), spread.max_groups)
    if large is None:
        return df, None
    same = _same(df, large, by)
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def _same(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> Column:
    """Row of ``df`` belongs to the row of ``table``, whose keys are named ``_r_``; null equals null."""
    same = F.lit(True)
    for key in keys:
        same = same & df[key].eqNullSafe(table[f"_r_{key}"])
    return same


def bounded_table(df: DataFrame, most: int) -> DataFrame | None:
    """``df`` for a join: broadcast up to ``most`` rows, stored beyond, None if empty."""
    found = df.limit(most + 1).collect()
    if not found:
        return None
    if len(found) > most:
        return stage(df)
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


def _cut(
    out: DataFrame, crowded: DataFrame, by: list[str], axis: str, rows_per_bin: float
) -> DataFrame:
    parts = F.ceil(F.col("_n") / rows_per_bin)
    cuts = crowded.select(
        *[F.col(k).alias(f"_r_{k}") for k in [*by, BIN]],
        "_lo",
        parts.alias("_parts"),
        ((F.col("_hi") - F.col("_lo")) / parts).alias("_step"),
    )
    # No step where all lie on one instant.
    place = F.coalesce(
        F.floor(F.try_divide(F.col(axis).cast("double") - F.col("_lo"), F.col("_step"))), F.lit(0)
    )
    start = F.col("_lo") + F.least(place, F.col("_parts") - 1) * F.col("_step")
    return out.join(cuts, _same(out, cuts, [*by, BIN]), "left").select(
        *[c for c in out.columns if c not in (BIN, HOT)],
        F.coalesce(start, F.col("_lo"), F.col(BIN)).alias(BIN),
        (F.col(HOT) | F.col("_parts").isNotNull()).alias(HOT),
    )


def _cut_ties(out: DataFrame, by: list[str], keys: list[str], spread: Spread) -> DataFrame:
    """Cut bins that are still too full along ``keys``; ``_bin`` becomes a path of numbers.

    Cut values are quantiles of about ``PICKS`` sampled rows per bin, at most ``TIE_PARTS`` at
    once. A bin below, at and between cut values each is one of its own, so a value
    that holds many rows is set apart at once. The last number of a bin is odd if all its
    rows are equal to a cut value: such a bin is done.
    """
    key = F.struct(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)])
    out = out.withColumn(BIN, F.array(BIN))
    for level in count():
        divisible = (F.size(BIN) == 1) | (F.element_at(BIN, -1) % 2 == 0)
        sizes = out.where(HOT).groupBy(*by, BIN).agg(F.count(F.lit(1)).alias("_n"))
        crowded = bounded_table(
            sizes.where((F.col("_n") >= 2 * spread.rows_per_bin) & divisible).select(
                *[F.col(k).alias(f"_r_{k}") for k in [*by, BIN]], "_n"
            ),
            spread.max_groups,
        )
        if crowded is None:
            return out
        hot = out.where(HOT)
        picked = hot.join(crowded, _same(hot, crowded, [*by, BIN])).where(
            F.rand(level) < F.lit(PICKS) / F.col("_n")
        )
        found = picked.groupBy(*[f"_r_{k}" for k in [*by, BIN]]).agg(
            F.sort_array(F.collect_list(key)).alias("_keys"), F.first("_n").alias("_n")
        )
        parts = F.least(F.ceil(F.col("_n") / spread.rows_per_bin), F.lit(TIE_PARTS))
        places = F.sequence(F.lit(1).cast("long"), parts - 1)
        values = F.transform(
            places, lambda i: F.get("_keys", F.floor(i * F.size("_keys") / parts).cast("int"))
        )
        cuts = bounded_table(
            found.select(*[f"_r_{k}" for k in [*by, BIN]], F.array_distinct(values).alias("_cuts")),
            spread.max_groups,
        )
        if cuts is None:
            continue  # Nothing was sampled; the next round draws other rows.
        place = F.size(F.filter("_cuts", lambda c: c <= key)) + F.size(
            F.filter("_cuts", lambda c: c < key)
        )
        path = F.concat(F.col(BIN), F.array(place.cast("double")))
        out = out.join(cuts, _same(out, cuts, [*by, BIN]), "left").select(
            *[c for c in out.columns if c != BIN],
            F.when(F.col("_cuts").isNotNull(), path).otherwise(F.col(BIN)).alias(BIN),
        )


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    axis: str,
    order: Sequence[Column],
    sums: dict[str, Column],
    spread: Spread = DEFAULT,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add, per group in order, running sums and ``<name>_total`` sums.

    ``order`` must start with ``axis`` ascending and be total within a group. Name its
    other columns as ``ties`` where many rows may be equal on ``axis``.
    """
    by = list(by)
    plain = df.select("*", *[c.alias(f"_s_{n}") for n, c in sums.items()])
    binned = with_bins(plain, by, axis, spread, ties)
    bins = (
        binned.where(HOT)
        .groupBy(*by, BIN)
        .agg(*[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums])
    )
    before = Window.partitionBy(*by).orderBy(BIN).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    seeds = bins.select(
        *by,
        BIN,
        F.lit(1).alias(SEED),
        *[F.sum(f"_s_{n}").over(whole).alias(f"_t_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(before).alias(f"_s_{n}") for n in sums],
    )
    rows = binned.drop(HOT).withColumn(SEED, F.lit(0)).unionByName(seeds, allowMissingColumns=True)
    part = Window.partitionBy(*by, BIN)
    run = part.orderBy(F.desc(SEED), *order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select(
        *df.columns,
        SEED,
        *[F.sum(f"_s_{n}").over(run).alias(n) for n in sums],
        *[
            F.coalesce(F.max(f"_t_{n}").over(part), F.sum(f"_s_{n}").over(part)).alias(f"{n}_total")
            for n in sums
        ],
    )
    return out.where(F.col(SEED) == 0).drop(SEED)


def with_neighbour_rows(
    df: DataFrame,
    by: Sequence[str],
    axis: str,
    order: Sequence[str],
    before: int,
    after: int,
    spread: Spread = DEFAULT,
) -> DataFrame:
    """Bins plus, in each bin of a large group, the rows around it as seeds.

    Every bin gets the ``before`` rows ahead of it and the ``after`` rows
    behind it (fewer at the ends of the group). Windows over
    ``(by, _bin)`` with row frames of that reach are then exact; keep the rows
    with ``_seed = 0`` afterwards.
    """
    by, order = list(by), list(order)
    cols = df.columns
    binned = with_bins(df, by, axis, spread, order)
    ranks = [F.col(c).alias(f"_k{i}") for i, c in enumerate([axis, *order])]
    keyed = binned.where(HOT).select(
        *by, BIN, F.struct(*ranks, F.struct(*cols).alias("_row")).alias("_item")
    )

    def edge(n: int, last: bool) -> DataFrame:
        """The n first or last rows of each bin, as one short sorted list."""
        fields = [F.col(f"_item._k{i}") for i in range(len(ranks))]
        fields = [f.desc_nulls_last() if last else f.asc_nulls_first() for f in fields]
        place = F.row_number().over(Window.partitionBy(*by, BIN).orderBy(*fields))
        return (
            keyed.withColumn("_place", place)
            .where(F.col("_place") <= n)
            .groupBy(*by, BIN)
            .agg(F.sort_array(F.collect_list("_item")).alias("_items"))
        )

    def from_neighbours(n: int, earlier: bool) -> DataFrame:
        """A bin holds a row or more, so the nearest n bins are far enough."""
        toward = F.asc(BIN) if earlier else F.desc(BIN)
        reach = Window.partitionBy(*by).orderBy(toward).rowsBetween(-n, -1)
        items = F.sort_array(F.flatten(F.collect_list("_items").over(reach)))
        near = F.slice("_near", -n, n) if earlier else F.slice("_near", 1, n)
        return (
            edge(n, earlier)
            .withColumn("_near", items)
            .select(BIN, F.explode(F.when(F.size("_near") <= n, F.col("_near")).otherwise(near)).alias("_item"))
            .select("_item._row.*", BIN, F.lit(1).alias(SEED))
        )

    rows = binned.drop(HOT).withColumn(SEED, F.lit(0))
    if before:
        rows = rows.unionByName(from_neighbours(before, True))
    if after:
        rows = rows.unionByName(from_neighbours(after, False))
    return rows
