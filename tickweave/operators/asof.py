"""As-of joins: the nearest earlier or later row of another table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import DAY, micros
from .spread import BIN, DEFAULT, HOT, SEED, Spread, with_bins

_AXIS = "_axis"
_SIDE = "_side"


@dataclass(frozen=True)
class Lookup:
    """A table to look up in.

    ``payload`` columns are added to the left rows. ``lag`` (microseconds) is
    taken off its times first, so a forward join finds the first row at or
    after ``t + lag``. ``order`` decides between rows at one instant.
    """

    df: DataFrame
    on: str
    payload: Sequence[str]
    order: Sequence[str] = ()
    lag: int = 0


def asof_join(
    left: DataFrame, lookups: Sequence[Lookup], on: str, by: Sequence[str],
    direction: str = "backward", tolerance: int | None = None, spread: Spread = DEFAULT,
) -> DataFrame:
    """For each left row the nearest row at or before (after) it, per key.

    Left rows and all lookups are stacked and read once in time order: one
    shuffle and one sort, whatever the number of lookups. The payload travels
    as a struct, so a matched row with null fields still counts; rows without a
    time match nothing. Keys with very
    many rows are cut into time bins; each bin starts with the row carried over
    from the bins before it. ``left`` and the lookups are scanned again to find
    these keys, so hand over stored tables if they are costly.
    """
    backward = {"backward": True, "forward": False}[direction]
    by = list(by)
    slots = [f"_m{i}" for i in range(len(lookups))]
    stacked = left.select("*", micros(left, on).alias(_AXIS), F.lit(1).alias(_SIDE))
    for slot, item in zip(slots, lookups):
        moment = micros(item.df, item.on) - item.lag
        fields = [F.col(c).alias(c) for c in item.payload]
        tie = F.struct(*item.order) if item.order else F.lit(0)
        stacked = stacked.unionByName(
            item.df.select(
                *by,
                moment.alias(_AXIS),
                F.lit(0).alias(_SIDE),
                tie.alias(f"_tie{slot}"),
                F.struct(moment.alias("_at"), *fields).alias(slot),
            ).where(F.col(_AXIS).isNotNull()),
            allowMissingColumns=True,
        )
    ties = [f"_tie{slot}" for slot in slots]
    binned = with_bins(stacked, by, _AXIS, spread)

    pick = F.max_by if backward else F.min_by

    def edge(slot: str) -> Column:
        place = F.struct(_AXIS, f"_tie{slot}")
        return pick(slot, F.when(F.col(slot).isNotNull(), place)).alias(slot)

    toward = F.asc if backward else F.desc
    passed = Window.partitionBy(*by).orderBy(toward(BIN)).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        binned.where(HOT)
        .groupBy(*by, BIN)
        .agg(*[edge(slot) for slot in slots])
        .select(
            *by, BIN, F.lit(1).alias(SEED), F.lit(0).alias(_SIDE),
            *[F.last(slot, ignorenulls=True).over(passed).alias(slot) for slot in slots],
        )
    )
    rows = binned.drop(HOT).withColumn(SEED, F.lit(0)).unionByName(carried, allowMissingColumns=True)
    run = (
        Window.partitionBy(*by, BIN)
        .orderBy(F.desc(SEED), toward(_AXIS), F.asc(_SIDE), *[toward(t) for t in ties])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = rows.select(
        *left.columns, _AXIS, SEED, _SIDE,
        *[F.last(slot, ignorenulls=True).over(run).alias(slot) for slot in slots],
    ).where((F.col(SEED) == 0) & (F.col(_SIDE) == 1))

    def field(slot: str, name: str) -> Column:
        value = F.when(F.col(_AXIS).isNotNull(), F.col(f"{slot}.{name}"))
        if tolerance is not None:
            value = F.when(F.abs(F.col(f"{slot}._at") - F.col(_AXIS)) <= tolerance, value)
        return value.alias(name)

    return found.select(
        *left.columns,
        *[field(slot, name) for slot, item in zip(slots, lookups) for name in item.payload],
    )


def asof_join_all(
    left: DataFrame, lookup: Lookup, on: str, slot: int = DAY, tolerance: int | None = None,
    spread: Spread = DEFAULT,
) -> DataFrame:
    """Backward as-of join without a key, e.g. one benchmark for all securities.

    Time slots take the place of the key. Each slot is first given the last
    lookup row from before it; the list of slots is as short as the calendar.
    A crowded slot is then cut further like any large key.
    """

    def slot_of(df: DataFrame, name: str) -> Column:
        moment = micros(df, name)
        return ((moment - F.pmod(moment, F.lit(slot).cast("long"))) / slot).cast("long")

    source = lookup.df.withColumn("_slot", slot_of(lookup.df, lookup.on))
    rows = left.withColumn("_slot", slot_of(left, on))
    kept = F.struct(*[F.col(c) for c in dict.fromkeys([lookup.on, *lookup.payload, *lookup.order])])
    place = F.struct(micros(source, lookup.on), *lookup.order)
    ends = source.groupBy("_slot").agg(F.max_by(kept, place).alias("_row"))
    slots = ends.unionByName(rows.select("_slot").distinct(), allowMissingColumns=True)
    slots = slots.groupBy("_slot").agg(F.first("_row", ignorenulls=True).alias("_row"))
    passed = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        slots.withColumn("_row", F.last("_row", ignorenulls=True).over(passed))
        .where(F.col("_row").isNotNull())
        .select("_row.*", "_slot")
    )
    columns = carried.columns
    seeded = Lookup(
        source.select(*columns).unionByName(carried), lookup.on, lookup.payload, lookup.order
    )
    return asof_join(rows, [seeded], on, ["_slot"], "backward", tolerance, spread).drop("_slot")
