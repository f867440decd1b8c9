"""German trading calendar: weekdays that are no nationwide public holiday."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Nationwide public holidays on a fixed month and day.
FIXED_HOLIDAYS = {
    "01-01": "Neujahr",
    "05-01": "Erster Mai",
    "10-03": "Tag der Deutschen Einheit",
    "12-25": "Erster Weihnachtstag",
    "12-26": "Zweiter Weihnachtstag",
}

# Nationwide public holidays as days after Easter Sunday.
EASTER_HOLIDAYS = {
    -2: "Karfreitag",
    1: "Ostermontag",
    39: "Christi Himmelfahrt",
    50: "Pfingstmontag",
}


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by Gauss' rule with its two late-date exceptions."""

    def div(a: Column, b: int) -> Column:
        return F.floor(a / b)

    golden, leap, week = year % 19, year % 4, year % 7
    century = div(year, 100)
    moon = (F.lit(15) - div(century * 8 + 13, 25) + century - div(century, 4)) % 30
    sun = (F.lit(4) + century - div(century, 4)) % 7
    full = (golden * 19 + moon) % 30
    wait = (leap * 2 + week * 4 + full * 6 + sun) % 7
    late = ((wait == 6) & (full == 29)) | ((wait == 6) & (full == 28) & (golden > 10))
    after = full + wait - F.when(late, 7).otherwise(0)
    return F.date_add(F.make_date(year.cast("int"), F.lit(3), F.lit(22)), after.cast("int"))


def holiday_name(day: Column) -> Column:
    """Name of the nationwide holiday on ``day``, else null."""
    month_day = F.date_format(day, "MM-dd")
    gap = F.datediff(day, easter_sunday(F.year(day)))
    name = F.lit(None).cast("string")
    for shift, label in EASTER_HOLIDAYS.items():
        name = F.when(gap == shift, label).otherwise(name)
    for key, label in FIXED_HOLIDAYS.items():
        name = F.when(month_day == key, label).otherwise(name)
    return name


def trading_calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per day of ``[start, end]`` with its previous trading day.

    A few thousand rows at most, so the single ordered window is harmless. The
    range starts two weeks early inside, so the first days know their
    predecessor too.
    """
    first = start - dt.timedelta(days=14)
    days = spark.range((end - first).days + 1).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias("d")
    )
    days = days.select(
        "d",
        (F.weekday("d") >= 5).alias("is_weekend"),
        holiday_name(F.col("d")).alias("holiday"),
    ).withColumn("is_trading", ~F.col("is_weekend") & F.col("holiday").isNull())
    earlier = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.max(F.when(F.col("is_trading"), F.col("d"))).over(earlier)
    return days.withColumn("prev_trading_day", previous).where(F.col("d") >= F.lit(start))


def with_prev_trading_day(df: DataFrame, calendar: DataFrame, date_col: str) -> DataFrame:
    """Add ``prev_trading_day``; the calendar is days only, so it is broadcast."""
    lookup = calendar.select(F.col("d").alias("_d"), "prev_trading_day")
    return df.join(F.broadcast(lookup), df[date_col] == F.col("_d"), "left").drop("_d")


def trading_day_count(calendar: DataFrame, start: dt.date, end: dt.date) -> int:
    """Trading days in ``[start, end]``, both ends in."""
    inside = F.col("d").between(F.lit(start), F.lit(end)) & F.col("is_trading")
    return calendar.where(inside).count()
