import datetime as dt

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tickweave.functions.cells import is_cancel
from tickweave.operators.consolidate import (
    consolidate, drop_cancelled_pairs, flag_profile, split_executions, trade_second, within_days,
)
from tickweave.operators.dedupe import (
    drop_nulls, duplicate_profile, keep_last, latest_value, rename_aliases, union_drifting,
)
from tickweave.operators.universe import (
    daily_activity, keys_active_often, keys_active_once, universe_active_days, universe_any_day,
)
from tickweave.operators.trading_calendar import trading_calendar

TRADE = "isin string, tradeTime timestamp, publishedTime timestamp, price double, size long, TVTIC string, flags string"
FIRST = ["tradeTime", "publishedTime", "TVTIC", "flags"]
ORDER = ["tradeTime", "publishedTime", "TVTIC"]


def at(text):
    return dt.datetime.fromisoformat(text + "+00:00")


def trade(isin, time, price, size, tid, flags="ALGO;", published=None):
    return (isin, at(time), at(published or time), price, size, tid, flags)


def test_keep_last(spark):
    df = spark.createDataFrame(
        [
            ("a", 1, "f1", "old"), ("a", 3, "f2", "new"), ("b", None, "f1", "unknown time"),
            ("b", 1, "f1", "known time"), (None, 1, "f1", "n1"), (None, 2, "f1", "n2"),
        ],
        "id string, t int, file string, v string",
    )
    got = {r["v"] for r in keep_last(df, ["id"], ["t", "v"]).collect()}
    assert got == {"new", "known time", "n2"}
    got = {r["v"] for r in keep_last(df, ["id"], ["t", "v"], ["file"]).collect()}
    assert got == {"old", "new", "known time", "n2"}
    got = {r["v"] for r in keep_last(df, ["id"], ["t", "v"], keep_null_keys=True).collect()}
    assert got == {"new", "known time", "n1", "n2"}


def test_keep_last_limits_before_the_shuffle(spark):
    plan = keep_last(spark.range(10).withColumn("k", F.col("id") % 3), ["k"], ["id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    below = text[text.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=40))
def test_keep_last_twice_changes_nothing(spark, rows):
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "k int, t int, i int")
    once = keep_last(df, ["k"], ["t", "i"])
    assert sorted(once.collect()) == sorted(keep_last(once, ["k"], ["t", "i"]).collect())


def test_consolidate(spark):
    df = spark.createDataFrame(
        [
            trade("A", "2024-04-03 08:00:00.200", 1.5, 10, "t2"),
            trade("A", "2024-04-03 08:00:00.100", 1.5, 5, "t1", None),
            trade("A", "2024-04-03 08:00:00.900", 1.6, 7, "t3"),
            trade("A", "2024-04-03 08:00:01.000", 1.5, 3, "t4", "ALGO;;AMND;"),
            trade("B", "2024-04-03 08:00:00.000", 2.0, 4, "t5"),
            trade("B", "2024-04-03 08:00:00.500", 2.0, 4, "t6", "CANC;"),
            trade("C", "2024-04-03 08:00:00.000", 2.0, 4, "t7"),
            trade("C", "2024-04-03 08:00:00.500", 2.0, 9, "t8", "CANC;"),
        ],
        TRADE,
    )
    got = consolidate(
        df, ["isin", "price"], trade_second(df), "size", is_cancel(F.col("flags")), ORDER, FIRST
    )
    rows = {(r["isin"], r["price"], r["size"], r["TVTIC"], r["flags"]) for r in got.collect()}
    assert rows == {
        ("A", 1.5, 15, "t1", None), ("A", 1.6, 7, "t3", "ALGO;"), ("A", 1.5, 3, "t4", "ALGO;;AMND;"),
    }
    fixed = consolidate(
        df, ["isin", "price"], trade_second(df), "size", is_cancel(F.col("flags")), ORDER,
        ["TVTIC"], "total_size", "ALGO;",
    )
    assert {r["flags"] for r in fixed.collect()} == {"ALGO;"}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 50), st.booleans()), min_size=1, max_size=40))
def test_consolidate_keeps_the_signed_sum(spark, rows):
    df = spark.createDataFrame(
        [(k, s, c, i) for i, (k, s, c) in enumerate(rows)], "k int, s long, c boolean, i int"
    )
    got = consolidate(df, ["k"], F.lit(0), "s", F.col("c"), ["i"], ["i"])
    want = {}
    for k, s, c in rows:
        want[k] = want.get(k, 0) + (-s if c else s)
    assert {r["k"]: r["size"] for r in got.collect()} == {k: v for k, v in want.items() if v > 0}


def test_time_bound_is_local_and_half_open(spark):
    df = spark.createDataFrame(
        [(at(t),) for t in [
            "2024-03-30 22:59:59.999999", "2024-03-30 23:00:00", "2024-03-31 21:59:59.999999",
            "2024-03-31 22:00:00",
        ]],
        "tradeTime timestamp",
    )
    # 2024-03-31 has 23 hours in Berlin.
    got = within_days(df, "tradeTime", dt.date(2024, 3, 31), dt.date(2024, 3, 31)).count()
    assert got == 2
    october = spark.createDataFrame(
        [(at(t),) for t in ["2024-10-26 21:59:59", "2024-10-26 22:00:00", "2024-10-27 22:59:59", "2024-10-27 23:00:00"]],
        "tradeTime timestamp",
    )
    assert within_days(october, "tradeTime", dt.date(2024, 10, 27), dt.date(2024, 10, 27)).count() == 2


def test_universe_limits_are_inclusive(spark):
    rows = [("ten", 500.0, 1, 1)] * 10 + [("nine", 600.0, 1, 1)] * 9
    rows += [("poor", 499.9, 1, 1)] * 10 + [("spread", 500.0, 1, d) for d in range(1, 11)]
    df = spark.createDataFrame(rows, "isin string, price double, size long, d int")
    got = universe_any_day(df, "isin", F.col("d"), "price", "size")
    assert {r["isin"] for r in got.collect()} == {"ten"} and got.count() == 10
    activity = daily_activity(df, "isin", F.col("d"), "price", "size")
    assert keys_active_once(activity, "isin", 1, 500.0).count() == 4
    assert {r["isin"] for r in keys_active_often(activity, "isin", 500.0, 10).collect()} == {"spread"}


def test_key_without_active_day_is_out_even_if_none_is_required(spark):
    df = spark.createDataFrame(
        [("a", 5000.0, 1, 2), ("b", 4999.0, 1, 2)], "isin string, price double, size long, d int"
    )
    first, last = dt.date(2024, 1, 1), dt.date(2024, 1, 20)
    calendar = trading_calendar(spark, first, last)
    got = universe_active_days(df, "isin", F.col("d"), "price", "size", calendar, first, last)
    assert [r["isin"] for r in got.collect()] == ["a"]


def test_cancelled_pairs(spark, small_bins):
    rows = [("A", 1, 10, i, "ALGO;") for i in range(9)] + [("A", 1, 10, 20 + i, "CANC;") for i in range(4)]
    rows += [("B", 1, 10, 50, "CANC;"), ("C", 1, 10, 60, "ALGO;"), ("C", 1, 11, 61, "CANC;"), ("D", 1, 1, 70, None)]
    df = spark.createDataFrame(rows, "isin string, t int, size int, id int, flags string")
    got = drop_cancelled_pairs(
        df, ["isin", "t", "size"], is_cancel(F.col("flags")), "id", ["id"], small_bins
    )
    assert sorted(r["id"] for r in got.collect()) == [4, 5, 6, 7, 8, 50, 60, 61, 70]


def test_profiles(spark):
    df = spark.createDataFrame(
        [("a", "f1", "ALGO;"), ("a", "f2", "ALGO;;AMND;"), ("b", "f1", "CANC;"), ("b", "f1", None)],
        "id string, file string, flags string",
    )
    row = duplicate_profile(df, "id", "file").first()
    assert tuple(row) == (4, 2, 1, 1, 2)
    assert {r["flag"]: r["rows"] for r in flag_profile(df).collect()} == {"ALGO": 2, "AMND": 1, "CANC": 1}
    parts = split_executions(df.withColumn("n", F.lit(2)), ["id", "file"], "n").collect()
    assert [tuple(r) for r in parts] == [("b", "f1", 2, 4)]


def test_names_unions_nulls(spark):
    df = spark.createDataFrame(
        [("a", "old", 1), ("a", "new", 2), ("a", None, 3), (None, "x", 4)], "k string, v string, o int"
    )
    assert [tuple(r) for r in latest_value(df, "k", "v", ["o"]).collect()] == [("a", "new")]
    left = spark.createDataFrame([("t1", "n")], "orderId string, displayName string")
    right = spark.createDataFrame([("t2", 5)], "TVTIC string, size int")
    both = union_drifting([left, right], {"orderId": "TVTIC"}, ["displayName"])
    assert sorted(map(tuple, both.collect()), key=str) == [("t1", None), ("t2", 5)]
    assert rename_aliases(right, {"orderId": "TVTIC"}).columns == ["TVTIC", "size"]
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert drop_nulls(nan).count() == 2
