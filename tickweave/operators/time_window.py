"""Features over a time range ``(t - period, t]`` per security."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import micros
from .spread import DEFAULT, RECUT, Spread, bounded_table, of_likely_large

# A count is the sum of ones, so that partial counts add up.
_COMBINE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
_SPAN = "_span"
_ROLE = "_role"
_SHIFTED = "_shifted"
_SPLITS = "_splits"
_OWN, _EARLIER, _BETWEEN = 1, 0, 2


@dataclass(frozen=True)
class Rolling:
    """One output: ``kind`` is sum, count, max, min or last."""

    name: str
    kind: str
    value: str | None = None


def _merge(kind: str, parts: Sequence[Column]) -> Column:
    if kind in ("sum", "count"):
        known = [F.coalesce(p, F.lit(0)) for p in parts]
        total = known[0]
        for part in known[1:]:
            total = total + part
        return total if kind == "count" else F.when(F.coalesce(*parts).isNotNull(), total)
    return F.greatest(*parts) if kind == "max" else F.least(*parts)


def _divisor_by_power(period: int) -> Column:
    """Map from p to the smallest number of spans of 2^p or more that divides the period."""
    small = [d for d in range(1, isqrt(period) + 1) if period % d == 0]
    divisors = [*small, *(period // d for d in reversed(small))]
    top = (period - 1).bit_length()
    found = {p: next(d for d in divisors if d >= min(1 << p, period)) for p in range(top + 1)}
    return F.create_map(*[F.lit(x).cast("long") for item in found.items() for x in item])


def _crowded_keys(df: DataFrame, key: str, period: int, spread: Spread) -> DataFrame | None:
    """Keys with too many rows within one period, with the spans a period of each is cut into.

    The number follows the density: while a span of a key holds ``2 * rows_per_bin`` rows at more
    than one instant, that key gets more spans. Only the crowded periods are looked at for it.
    """
    homed = df.select(key, "_t", F.floor(F.col("_t") / period).alias("_home"))
    rows = of_likely_large(homed, [key, "_home"], spread)
    if rows is None:
        return None
    splits_of, top = _divisor_by_power(period), (period - 1).bit_length()

    def power(spans: Column) -> Column:
        return F.least(F.ceil(F.log2(spans)), F.lit(top)).cast("long")

    sizes = rows.groupBy(key, "_home").agg(F.count(F.lit(1)).alias("_n"))
    worst = sizes.groupBy(key).agg(F.max("_n").alias("_n")).where(F.col("_n") >= spread.min_rows)
    wanted = F.greatest(F.ceil(F.col("_n") / spread.rows_per_bin), F.lit(2))
    current = bounded_table(
        worst.select(F.col(key).alias("_r_key"), power(wanted).alias("_power")), spread.max_groups
    )
    rounds = []
    while current is not None:
        rounds.append(current)
        cut = current.withColumn(_SPLITS, splits_of[F.col("_power")])
        width = F.lit(period).cast("long") / F.col(_SPLITS)
        spans = (
            rows.join(cut, rows[key].eqNullSafe(cut["_r_key"]))
            .groupBy("_r_key", "_power", _SPLITS, F.floor(F.col("_t") / width).alias("_home"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
        )
        full = spans.where(
            (F.col("_n") >= 2 * spread.rows_per_bin) & (F.col("_lo") < F.col("_hi")) & (F.col("_power") < top)
        )
        more = power(F.col(_SPLITS) * F.col("_n") * RECUT / spread.rows_per_bin)
        current = bounded_table(
            full.groupBy("_r_key").agg(F.max(F.greatest(more, F.col("_power") + 1)).alias("_power")),
            spread.max_groups,
        )
    if not rounds:
        return None
    table = rounds[0]
    if len(rounds) > 1:
        # As long as the first list: later rounds hold keys of it.
        latest = reduce(DataFrame.unionByName, rounds).groupBy("_r_key").agg(F.max("_power").alias("_power"))
        table = bounded_table(latest, spread.max_groups)
    return table.select("_r_key", splits_of[F.col("_power")].alias(_SPLITS))


def time_window(
    df: DataFrame, key: str, ts: str, period: int, outputs: Sequence[Rolling],
    order: Sequence[str], spread: Spread = DEFAULT, within: Sequence[str] = (),
) -> DataFrame:
    """Add rolling values over the last ``period`` microseconds, ties included.

    Time is cut into spans as long as the period. A window then is: the own
    span up to ``t`` (a running value) and the rest of the span before (a
    running value from its end). Both need the rows of two spans only, so each
    row is read once and sent to its own span and, without its other columns, to the next: one
    shuffle by (key, span) and linear work in each task, however many rows a window holds.

    Keys too crowded for that get ``k`` shorter spans per period, as many as their densest
    moment asks for. Their rows go ``k`` spans ahead, and the whole spans between are summed up
    in a table with one row per span, which each span receives as a seed row.

    With ``within``, windows hold only rows equal in these columns too. The groups of
    (key, within) must be small then: a ``df`` that is already partitioned by them, or by some
    of them, is not shuffled again, and no group is cut.
    """
    keys = [key, *within]
    rolled = [o for o in outputs if o.kind != "last"]
    lasts = [o for o in outputs if o.kind == "last"]
    based = df.select(
        "*",
        micros(df, ts).alias("_t"),
        *[
            (F.lit(1) if o.kind == "count" and o.value is None
             else F.col(o.value).isNotNull().cast("int") if o.kind == "count"
             else F.col(o.value)).alias(f"_v_{o.name}")
            for o in rolled
        ],
    )
    table = None if within else _crowded_keys(based, key, period, spread)
    if table is not None:
        based = based.join(table, based[key].eqNullSafe(table["_r_key"]), "left")
        based = based.drop("_r_key").withColumn(_SPLITS, F.coalesce(_SPLITS, F.lit(1).cast("long")))
    else:
        based = based.withColumn(_SPLITS, F.lit(1).cast("long"))
    width = F.lit(period).cast("long") / F.col(_SPLITS)
    home = ((F.col("_t") - F.pmod(F.col("_t"), width.cast("long"))) / width).cast("long")
    based = based.withColumn("_home", home)

    ahead = F.col("_home") + F.col(_SPLITS)
    copies = _copies((_OWN, F.col("_home"), F.col("_t")), (_EARLIER, ahead, F.col("_t") + period))
    own = F.col(f"_copy.{_ROLE}") == _OWN
    values = [f"_v_{o.name}" for o in rolled]
    rows = based.withColumn("_copy", F.explode(copies)).select(
        *keys,
        *[F.when(own, F.col(c)).alias(c) for c in dict.fromkeys([*df.columns, "_t"]) if c not in keys],
        *values,
        "_copy.*",
    )
    if table is not None and rolled:
        between = _whole_spans_between(based, key, rolled)
        rows = rows.unionByName(between, allowMissingColumns=True)

    part = Window.partitionBy(*keys, _SPAN)
    upto = part.orderBy(_SHIFTED).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def value_of(o: Rolling) -> Column:
        parts = _both_spans(o, [*keys, _SPAN])
        if table is not None:
            parts.append(F.max(_only(_BETWEEN, o)).over(part))
        return _merge(o.kind, parts)

    place = F.when(F.col(_ROLE) == _OWN, F.struct("_t", *order))
    columns = [value_of(o).alias(o.name) for o in rolled]
    if lasts:
        final = F.max_by(F.struct(*[F.col(o.value).alias(o.name) for o in lasts]), place).over(upto)
        columns.append(final.alias("_last"))
    out = rows.select(*df.columns, _ROLE, *columns).where(F.col(_ROLE) == _OWN)
    return out.select(
        *df.columns,
        *[o.name if o.kind != "last" else F.col(f"_last.{o.name}").alias(o.name) for o in outputs],
    )


def _copies(*places: tuple[int, Column, Column]) -> Column:
    """The (role, span, place) a row takes part with, to explode."""
    return F.array(
        *[F.struct(F.lit(r).alias(_ROLE), span.alias(_SPAN), at.alias(_SHIFTED)) for r, span, at in places]
    )


def _only(role: int, o: Rolling) -> Column:
    return F.when(F.col(_ROLE) == role, F.col(f"_v_{o.name}"))


def _both_spans(o: Rolling, keys: Sequence[str]) -> list[Column]:
    """Running value of the own span up to a row, and of the span before from its end down to it."""
    part = Window.partitionBy(*keys)
    upto = part.orderBy(_SHIFTED).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    back = part.orderBy(F.desc(_SHIFTED), F.desc(_ROLE)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    combine = _COMBINE[o.kind]
    return [combine(_only(_OWN, o)).over(upto), combine(_only(_EARLIER, o)).over(back)]


def _whole_spans_between(based: DataFrame, key: str, rolled: Sequence[Rolling]) -> DataFrame:
    """For each span of a crowded key: its ``k - 1`` predecessors combined.

    The same two halves as above, with spans in place of rows: blocks of ``k - 1`` spans, the
    own block up to the span before and the rest of the block ahead of it. So the
    work is linear in the spans, and a key's spans lie in many tasks.
    """
    whole = (
        based.where(F.col(_SPLITS) > 1)
        .groupBy(key, _SPLITS, "_home")
        .agg(*[_COMBINE[o.kind](f"_v_{o.name}").alias(f"_v_{o.name}") for o in rolled])
    )
    reach = F.col(_SPLITS) - 1
    after = F.col("_home") + 1

    def block(place: Column) -> Column:
        return F.floor(place / reach)

    copies = _copies(
        (_BETWEEN, block(F.col("_home")), F.col("_home")),
        (_OWN, block(after), after),
        (_EARLIER, block(after) + 1, after + reach),
    )
    rows = whole.withColumn("_copy", F.explode(copies)).select(
        key, "_home", *[f"_v_{o.name}" for o in rolled], "_copy.*"
    )
    merged = [_merge(o.kind, _both_spans(o, [key, _SPAN])).alias(f"_w_{o.name}") for o in rolled]
    found = rows.select(key, "_home", _ROLE, *merged).where(F.col(_ROLE) == _BETWEEN)
    return found.select(
        key, F.col("_home").alias(_SPAN), F.lit(_BETWEEN).alias(_ROLE),
        *[F.col(f"_w_{o.name}").alias(f"_v_{o.name}") for o in rolled],
    )


def open_times(df: DataFrame, key: str, day: str, ts: str) -> DataFrame:
    """First tick of each (key, day)."""
    return df.groupBy(key, day).agg(F.min(ts).alias("open_time"))


def after_open(df: DataFrame, ts: str, open_ts: str, low: int, high: int) -> DataFrame:
    """Rows from ``low`` to ``high`` microseconds after the open, both ends in."""
    since = micros(df, ts) - micros(df, open_ts)
    return df.where(since.between(low, high))
