"""Parquet and CSV tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """One scan over one or many files, folders or globs."""
    return spark.read.parquet(*paths)


def write_parquet(
    df: DataFrame, path: str, partition_by: str | None = None, mode: str = "errorifexists",
    sort_by: tuple[str, ...] = (),
) -> None:
    """Parquet sink; rows are sorted within each file, not across them.

    With ``partition_by`` the rows go to their partition's tasks by a rebalance,
    which lets AQE split a partition that is too large for one file.
    """
    if partition_by:
        df = df.hint("rebalance", F.col(partition_by))
    if sort_by:
        df = df.sortWithinPartitions(*[c for c in [partition_by] if c], *sort_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV sink with a header, for the strategy report."""
    df.write.mode(mode).option("header", True).csv(path)


def write_daily_files(df: DataFrame, path: str, day: str, mode: str = "append") -> None:
    """Delimited files by day, each with a header line and ``;`` between cells."""
    writer = df.write.mode(mode).partitionBy(day).option("header", True).option("sep", ";")
    writer = writer.option("quoteAll", True).option("escape", '"')
    # The writer would trim blanks by default.
    writer = writer.option("ignoreLeadingWhiteSpace", False)
    writer.option("ignoreTrailingWhiteSpace", False).csv(path)
