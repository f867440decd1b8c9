"""Do the daily files hold the days their names promise, and is a day missing?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import broadcast_if_small, stage
from .spread import DEFAULT, Spread, running_totals
from .trading_calendar import with_prev_trading_day


def date_text(cells: DataFrame, ts: str = "tradeTime") -> Column:
    """First ten characters of the time text."""
    return F.substring(ts, 1, 10)


def date_spans(cells: DataFrame, ts: str = "tradeTime") -> DataFrame:
    """Per source: rows, first and last date, first row (from 0) of the last date.

    Positions count up by one inside a split, so a row's number is its distance
    from the split's first row plus the rows of the splits before. Only one row
    per (split, date) is shuffled, never the lines themselves; this short table
    is stored, so the files are read once.
    """
    per_date = cells.groupBy("source", "part", "block", date_text(cells, ts).alias("_date")).agg(
        F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    per_date = stage(per_date)
    split = Window.partitionBy("source", "part", "block")
    placed = per_date.withColumn("_base", F.min("_first").over(split))
    splits = placed.groupBy("source", "part", "block").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("source").orderBy("part", "block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = splits.select(
        "source", "part", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    dated = placed.join(starts, ["source", "part", "block"]).groupBy("source", "_date").agg(
        F.sum("_n").alias("_n"),
        F.min(F.col("_start") + F.col("_first") - F.col("_base")).alias("_row"),
    )
    return dated.groupBy("source").agg(
        F.sum("_n").alias("rows"),
        F.min("_date").alias("min_date"),
        F.max("_date").alias("max_date"),
        F.max_by("_row", "_date").alias("max_date_first_row"),
    )


def row_numbers(
    df: DataFrame, source: str, axis: str, order: tuple[str, ...] = (), spread: Spread = DEFAULT
) -> DataFrame:
    """Number the rows of each source from 0 in the order of ``axis``."""
    fields = [F.col(axis), *[F.col(c) for c in order]]
    counted = running_totals(df, [source], axis, fields, {"_count": F.lit(1)}, spread, order)
    return counted.select(*df.columns, (F.col("_count") - 1).alias("row_num"))


def first_rows(cells: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each source; the limit applies before the shuffle."""
    place = Window.partitionBy("source").orderBy("part", "block", "pos")
    ranked = cells.withColumn("_rank", F.row_number().over(place))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def audit_file_dates(
    files: DataFrame, cells: DataFrame, calendar: DataFrame, ts: str = "tradeTime",
    with_column: DataFrame | None = None, failed: DataFrame | None = None,
) -> DataFrame:
    """One row per source with its dates, the expected date and what is wrong.

    ``with_column`` lists the sources whose header has the time column; without
    it a file that gave no row counts as empty. ``failed`` lists the sources that
    could not be read. A file whose name gives a day outside the calendar matches
    nothing.
    """
    named = files.groupBy("source").agg(
        F.max("file_date").alias("file_date"), F.sum("file_size").alias("_size")
    )
    expected = with_prev_trading_day(named, calendar, "file_date").withColumnRenamed(
        "prev_trading_day", "expected_date"
    )
    out = expected.join(date_spans(cells, ts), "source", "left")
    known = F.lit(True)
    if with_column is not None:
        flags = with_column.select("source", F.lit(True).alias("_known"))
        out = out.join(broadcast_if_small(flags), "source", "left")
        known = F.coalesce("_known", F.lit(False))
    broken = F.lit(False)
    if failed is not None:
        marks = failed.select("source", F.lit(True).alias("_failed"))
        out = out.join(broadcast_if_small(marks), "source", "left")
        broken = F.coalesce("_failed", F.lit(False))
    seen = F.try_to_timestamp("max_date", F.lit("yyyy-MM-dd")).cast("date")
    matches = F.coalesce(seen == F.col("expected_date"), F.lit(False))
    issue = (
        F.when(F.col("file_date").isNull(), "invalid date in file name")
        .when(broken, "failed to read")
        .when(F.col("_size") == 0, "file is empty")
        .when(~known, "time column not found")
        .when(F.coalesce("rows", F.lit(0)) == 0, "file is empty")
        .when(F.coalesce("min_date", F.lit("")) == "", "no dates")
        .when(F.coalesce("max_date", F.lit("")) == "", "no dates")
        .when(F.col("expected_date").isNull(), "day outside the calendar")
        .when(~matches, "date does not match file name")
    )
    return out.select(
        "source", "file_date", "expected_date", "rows", "min_date", "max_date",
        "max_date_first_row", matches.alias("matches"), issue.alias("issue"),
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("issue").isNull()).alias("perfect"),
        F.count_if(F.col("issue").isNotNull()).alias("with_issues"),
    )


def assign_file_dates(
    files: DataFrame, cells: DataFrame, calendar: DataFrame, ts: str = "tradeTime",
    min_bytes: int = 5 * 1024 * 1024, sample_rows: int | None = None,
) -> DataFrame:
    """The day most rows of each source belong to, and what speaks against it.

    ``sample_rows`` looks at the first rows only, as a quick check would. Of dates
    equally frequent the earliest counts; null dates form a group of their own.
    Sources below ``min_bytes`` or with a bad name stay in the result with an
    ``issue``; leave them out of the coverage by that column. A date that differs
    from the expected one still counts but has ``matches`` false.
    """
    sized = files.groupBy("source").agg(
        F.max("file_date").alias("file_date"), F.sum("file_size").alias("file_size")
    )
    expected = with_prev_trading_day(sized, calendar, "file_date").withColumnRenamed(
        "prev_trading_day", "expected_date"
    )
    text = F.coalesce(date_text(cells, ts), F.lit(""))
    seen = cells if sample_rows is None else first_rows(cells, sample_rows)
    counts = seen.groupBy("source", text.alias("_date")).agg(F.count(F.lit(1)).alias("_n"))
    rank = Window.partitionBy("source").orderBy(F.desc("_n"), "_date")
    major = counts.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") == 1)
    day = F.try_to_timestamp("_date", F.lit("yyyy-MM-dd")).cast("date")
    out = expected.join(major, "source", "left").withColumn("majority_date", day)
    issue = (
        F.when(F.col("file_date").isNull(), "invalid date in file name")
        .when(F.col("file_size") < min_bytes, "file too small")
        .when(F.col("majority_date").isNull(), "no dates")
    )
    return out.select(
        "source", "file_size", "file_date", "expected_date", "majority_date",
        F.coalesce(F.col("majority_date") == F.col("expected_date"), F.lit(False)).alias("matches"),
        issue.alias("issue"),
    )


def coverage(assigned: DataFrame, calendar: DataFrame, day: str, source: str) -> DataFrame:
    """Trading days without a source, and sources on days without trading.

    Of several sources for one day the last by name is reported.
    """
    by_day = assigned.where(F.col(day).isNotNull()).groupBy(F.col(day).alias("d")).agg(
        F.max(source).alias("source")
    )
    days = calendar.join(broadcast_if_small(by_day), "d", "left")
    # The words for days without trading.
    reason = F.when(F.col("is_weekend"), F.lit("Weekend")).otherwise(
        F.concat(F.lit("Holiday ("), F.col("holiday"), F.lit(")"))
    )
    missing = F.col("is_trading") & F.col("source").isNull()
    extra = ~F.col("is_trading") & F.col("source").isNotNull()
    return days.where(missing | extra).select(
        "d",
        F.when(missing, "missing").otherwise("no trading day").alias("kind"),
        F.when(extra, reason).alias("reason"),
        "source",
    )


def coverage_counts(assigned: DataFrame, calendar: DataFrame, day: str, source: str) -> DataFrame:
    """One row: trading days with a source, without one, and extra days."""
    by_day = assigned.where(F.col(day).isNotNull()).groupBy(F.col(day).alias("d")).agg(
        F.max(source).alias("source")
    )
    days = calendar.join(broadcast_if_small(by_day), "d", "left")
    there = F.col("source").isNotNull()
    return days.agg(
        F.count_if(F.col("is_trading") & there).alias("valid_days"),
        F.count_if(F.col("is_trading") & ~there).alias("missing_days"),
        F.count_if(~F.col("is_trading") & there).alias("extra_days"),
    )


def missing_by_month(report: DataFrame) -> DataFrame:
    """Missing days per month as one text; a month holds 31 days at most."""
    day = F.date_format("d", "dd")
    return (
        report.where(F.col("kind") == "missing")
        .groupBy(F.date_format("d", "yyyy-MM").alias("month"))
        .agg(F.array_join(F.array_sort(F.collect_list(day)), ", ").alias("days"))
    )
