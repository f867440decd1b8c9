"""Duplicate removal, latest-value maps and unions of drifting layouts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scope: Sequence[str] = (),
    keep_null_keys: bool = False,
) -> DataFrame:
    """One row per key: the last one by ``order`` (nulls first, so never last).

    ``scope`` narrows the search, e.g. to one file. Null keys fall together
    into one survivor unless ``keep_null_keys``. The ``= 1`` filter becomes a
    limit before the shuffle, so each task sends one row per key, however often
    the key occurs.
    """
    latest = [F.col(c).desc_nulls_last() for c in order]
    rank = F.row_number().over(Window.partitionBy(*scope, *keys).orderBy(*latest))
    if not keep_null_keys:
        return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return keep_last(df.where(known), keys, order, scope).unionByName(df.where(~known))


def latest_value(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """The value seen last for each key; rows with a null in either are ignored."""
    pairs = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    return pairs.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows without a null in ``columns`` (default all); NaN is a value."""
    for name in columns or df.columns:
        df = df.where(F.col(name).isNotNull())
    return df


def rename_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Rename a column where its alias occurs."""
    return df.withColumnsRenamed({old: new for old, new in aliases.items() if old in df.columns})


def union_drifting(
    frames: Sequence[DataFrame],
    aliases: dict[str, str] | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Union by name after renaming aliases; a missing column is null."""
    frames = [rename_aliases(f, aliases or {}).drop(*drop) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def duplicate_profile(df: DataFrame, id_col: str, source: str | Column) -> DataFrame:
    """How unique an id is within one source and across all sources.

    Two chained aggregations: per (source, id), then per id, so a hot id is
    combined before each shuffle.
    """
    source = F.col(source) if isinstance(source, str) else source
    local = df.groupBy(source.alias("_source"), F.col(id_col).alias("_id")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    per_id = local.groupBy("_id").agg(
        F.sum("_n").alias("_n"),
        F.max("_n").alias("_most"),
        F.count(F.lit(1)).alias("_sources"),
    )
    return per_id.agg(
        F.sum("_n").alias("rows"),
        F.count(F.lit(1)).alias("ids"),
        F.count_if(F.col("_most") > 1).alias("ids_repeated_in_source"),
        F.count_if(F.col("_sources") > 1).alias("ids_in_several_sources"),
        F.max("_n").alias("most_copies"),
    )
