"""Rolling windows and as-of joins against brute force."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tickweave.functions.times import HOUR, SECOND
from tickweave.operators.asof import Lookup, asof_join, asof_join_all
from tickweave.operators.labels import breakout_label, with_benchmark_delta
from tickweave.operators.spread import DEFAULT, Spread
from tickweave.operators.split import chrono_split
from tickweave.operators.tick_window import complete_tick_rows, tick_features
from tickweave.operators.time_window import Rolling, _crowded_keys, after_open, open_times, time_window

OUT = [
    Rolling("top", "max", "price"), Rolling("low", "min", "price"), Rolling("total", "sum", "size"),
    Rolling("n", "count"), Rolling("sizes", "count", "size"), Rolling("final", "last", "price"),
]


def brute(rows, period):
    want = set()
    for key, t, i, price, size in rows:
        near = [r for r in rows if r[0] == key and t - period < r[1] <= t]
        sizes = [r[4] for r in near if r[4] is not None]
        last = max(near, key=lambda r: (r[1], r[2]))
        want.add((
            i, max(r[3] for r in near), min(r[3] for r in near), sum(sizes) if sizes else None,
            len(near), len(sizes), last[3],
        ))
    return want


@pytest.mark.parametrize("per_bin", [1000, 20, 6, 1])
def test_time_window_equals_brute_force(spark, per_bin):
    random.seed(per_bin)
    rows = [
        (random.choice("aab"), random.randrange(-200, 800), i, random.randrange(100), random.choice([None, 1, 2]))
        for i in range(250)
    ]
    df = spark.createDataFrame(rows, "key string, t long, id long, price long, size long")
    got = time_window(df, "key", "t", 100, OUT, ["id"], Spread(2 * per_bin, per_bin, 50))
    assert {tuple(r)[2:3] + tuple(r)[5:] for r in got.collect()} == brute(rows, 100)


PERIOD = 86_400


def burst_rows(n=420):
    """Half of the rows of a key in one 500th of a period, some of them at one instant."""
    random.seed(9)
    rows = []
    for i in range(n):
        t = random.randrange(50_000, 50_170) if i % 2 else random.randrange(-PERIOD, 4 * PERIOD)
        rows.append((random.choice("aab"), 50_010 if i % 20 == 1 else t, i, random.randrange(100), random.choice([None, 1, 2])))
    return rows


@pytest.mark.parametrize("most", [500, 1])
def test_bursts_get_finer_spans(spark, most):
    rows = burst_rows()
    df = spark.createDataFrame(rows, "key string, t long, id long, price long, size long")
    limits = Spread(20, 10, most)
    table = {r[0]: r[1] for r in _crowded_keys(df.withColumn("_t", F.col("t")), "key", PERIOD, limits).collect()}
    assert set(table) == {"a", "b"} and all(PERIOD % k == 0 and k > 500 for k in table.values())
    spans = {}
    for key, t, *_ in rows:
        spans.setdefault((key, t // (PERIOD // table[key])), []).append(t)
    assert all(len(ts) < 20 or len(set(ts)) == 1 for ts in spans.values())
    got = time_window(df, "key", "t", PERIOD, OUT, ["id"], limits)
    assert {tuple(r)[2:3] + tuple(r)[5:] for r in got.collect()} == brute(rows, PERIOD)


def test_last_alone_in_a_burst(spark):
    rows = burst_rows(200)
    df = spark.createDataFrame(rows, "key string, t long, id long, price long, size long")
    got = time_window(df, "key", "t", PERIOD, OUT[-1:], ["id"], Spread(20, 10, 50))
    assert {(r["id"], r["final"]) for r in got.collect()} == {(w[0], w[-1]) for w in brute(rows, PERIOD)}


def test_time_window_reads_its_table_once(spark, tmp_path):
    spark.createDataFrame([("a", 0, 1, 9, 1, "x")], "key string, t long, id long, price long, size long, more string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = time_window(df, "key", "t", 100, OUT, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_time_window_edges(spark):
    """A row exactly one period back is outside, one microsecond later inside."""
    rows = [("a", 0, 1, 9, 1), ("a", 1, 2, 5, 1), ("a", 2 * HOUR, 3, 1, 1)]
    df = spark.createDataFrame(rows, "key string, t long, id long, price long, size long")
    got = {r["id"]: (r["top"], r["n"]) for r in time_window(df, "key", "t", 2 * HOUR, OUT, ["id"]).collect()}
    assert got == {1: (9, 1), 2: (9, 2), 3: (5, 2)}


def test_time_window_needs_one_shuffle(spark):
    df = spark.createDataFrame([("a", 0, 1, 9, 1)], "key string, t long, id long, price long, size long")
    plan = time_window(df, "key", "t", 100, OUT, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_open_slice(spark):
    df = spark.createDataFrame(
        [("a", 1, 10), ("a", 1, 12), ("a", 1, 14), ("a", 1, 15), ("a", 2, 100)], "key string, d int, t long"
    )
    opened = df.join(open_times(df, "key", "d", "t"), ["key", "d"])
    assert sorted(r["t"] for r in after_open(opened, "t", "open_time", 2, 4).collect()) == [12, 14]


def study(spread, **durations):
    from tickweave.plans.breakout import BreakoutStudy

    hours = {"past": 2, "slice_from": 2, "slice_to": 6, **durations}
    return BreakoutStudy(zone=None, spread=spread, **{k: v * HOUR for k, v in hours.items()})


TICKS = "isin string, s long, TVTIC long, price long, size long"


@pytest.mark.parametrize("past", [2, 3])
@pytest.mark.parametrize("most", [1000, 40, 3])
def test_past_features_equal_brute_force(spark, past, most):
    """No day, some days and all days are too large for one task."""
    random.seed(most)
    rows = [
        (random.choice("aab"), random.choice([0, 0, 0, 86_400]) + 900 * random.randrange(4, 44), i, random.randrange(50), 1 + i % 3)
        for i in range(160)
    ]
    odd = [(None, 50_000, 900, 1, 1), ("a", None, 901, 1, 1), (None, 50_000 + 9_000, 902, 1, 1)]
    df = spark.createDataFrame([*rows, *odd], TICKS).withColumn("tradeTime", F.timestamp_seconds("s"))
    got = study(Spread(most, max(most // 2, 1), 50), past=past).past_features(df)
    want = set()
    for key, t, i, _, _ in rows:
        opened = min(r[1] for r in rows if r[0] == key and r[1] // 86_400 == t // 86_400)
        if 2 * 3600 <= t - opened <= 6 * 3600:
            near = [r for r in rows if r[0] == key and t - past * 3600 < r[1] <= t]
            last = max(near, key=lambda r: (r[1], r[2]))
            want.add((key, i, last[3], max(r[3] for r in near), sum(r[3] * r[4] for r in near), len(near), opened))
    found = got.withColumn("open_time", F.unix_seconds("open_time")).drop("tradeTime").collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 10


def test_past_features_need_one_shuffle_and_no_join(spark):
    df = spark.createDataFrame([("a", 0, 1, 9, 1)], TICKS).withColumn("tradeTime", F.timestamp_seconds("s"))

    def plan(**durations):
        return study(DEFAULT, **durations).past_features(df)._jdf.queryExecution().executedPlan().toString()

    assert plan().count("Exchange") == 1 and "Join" not in plan()
    assert "Join" in plan(slice_from=1)


def nearest(left, right, direction, keyed=True, tolerance=None):
    want = set()
    for key, t, i in left:
        side = [r for r in right if not keyed or r[0] == key]
        if direction == "backward":
            side = [r for r in side if r[1] <= t]
            hit = max(side, key=lambda r: (r[1], r[2]), default=None)
        else:
            side = [r for r in side if r[1] >= t]
            hit = min(side, key=lambda r: (r[1], r[2]), default=None)
        if hit and tolerance is not None and abs(hit[1] - t) > tolerance:
            hit = None
        want.add((i, hit and hit[3]))
    return want


ROWS = st.lists(st.tuples(st.sampled_from("aab"), st.integers(0, 60)), min_size=1, max_size=40)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(ROWS, ROWS, st.sampled_from(["backward", "forward"]), st.sampled_from([None, 5]))
@pytest.mark.parametrize("spread", [DEFAULT, Spread(4, 2, 50)], ids=["whole", "bins"])
def test_asof_equals_brute_force(spark, spread, a, b, direction, tolerance):
    left = [(k, t, i) for i, (k, t) in enumerate(a)]
    # Every third payload is null: the row still counts as the match.
    right = [(k, t, i, None if i % 3 == 0 else i) for i, (k, t) in enumerate(b)]
    ldf = spark.createDataFrame(left, "key string, t long, id long")
    rdf = spark.createDataFrame(right, "key string, t long, rid long, v long")
    got = asof_join(
        ldf, [Lookup(rdf, "t", ["v"], ["rid"])], "t", ["key"], direction, tolerance, spread
    )
    assert {(r["id"], r["v"]) for r in got.collect()} == nearest(left, right, direction, True, tolerance)


@pytest.mark.parametrize("spread", [DEFAULT, Spread(4, 2, 50)], ids=["whole", "bins"])
def test_asof_without_key(spark, spread):
    random.seed(1)
    left = [("x", random.choice([random.randrange(100), 450 + random.randrange(9), 990]), i) for i in range(60)]
    right = [("x", random.choice([5, 40, 41, 300, 452, 455, 1200]), i, i) for i in range(12)]
    ldf = spark.createDataFrame(left, "key string, t long, id long")
    rdf = spark.createDataFrame(right, "key string, t long, rid long, v long").drop("key")
    got = asof_join_all(ldf, Lookup(rdf, "t", ["v"], ["rid"]), "t", slot=100, spread=spread)
    assert {(r["id"], r["v"]) for r in got.collect()} == nearest(left, right, "backward", False)


def test_two_lookups_share_one_shuffle_of_rows(spark):
    left = spark.createDataFrame([("a", 10, 1)], "key string, t long, id long")
    right = spark.createDataFrame([("a", 40, 7), ("a", 90, 8)], "key string, t long, v long")
    looks = [Lookup(right.withColumnRenamed("v", "w"), "t", ["w"], (), 30), Lookup(right, "t", ["v"], (), 31)]
    out = asof_join(left, looks, "t", ["key"], "forward")
    assert [tuple(r) for r in out.collect()] == [("a", 10, 1, 7, 8)]


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_rows_without_time_match_nothing(spark, direction):
    left = spark.createDataFrame([("a", None, 1), ("a", 5, 2)], "key string, t long, id long")
    right = spark.createDataFrame([("a", None, 7), ("a", 5, 8)], "key string, t long, v long")
    got = asof_join(left, [Lookup(right, "t", ["v"])], "t", ["key"], direction).collect()
    assert {r["id"]: r["v"] for r in got} == {1: None, 2: 8}


def test_benchmark_delta_over_a_silent_day(spark):
    day = 86_400 * SECOND
    bench = spark.createDataFrame([(0, 10.0, 1), (5, 20.0, 2), (2 * day, 30.0, 3)], "t long, price double, id long")
    rows = spark.createDataFrame([(3, 1), (day + 1, 2), (2 * day + 1, 3)], "t long, rid long")
    got = with_benchmark_delta(
        rows, bench, "t", "price", ["id"], lambda df: F.floor(F.col("t") / day)
    )
    # No close before day 0; no close of its own on the silent day 1.
    assert {r["rid"]: r["bench_delta"] for r in got.collect()} == {1: None, 2: None, 3: 0.5}


def test_label_drops_incomplete_rows(spark):
    df = spark.createDataFrame([(100.5, 100.0), (100.4, 100.0), (None, 100.0)], "f double, p double")
    got = breakout_label(df, "f", "p", 1.005).collect()
    assert [r["target_label"] for r in got] == [int(100.5 >= 100.0 * 1.005), 0]


@pytest.mark.parametrize("spread", [DEFAULT, Spread(20, 6, 50)], ids=["whole", "bins"])
def test_tick_features(spark, spread):
    rows = [(k, i * 1_500, i, float(i % 7 + 1), 2) for k, n in [("a", 9), ("b", 10), ("c", 49), ("d", 52)] for i in range(n)]
    df = spark.createDataFrame(rows, "isin string, t long, id long, price double, size long")
    got = tick_features(df, "isin", "t", ["id"], "price", "size", spread=spread).collect()
    by = {(r["isin"], r["id"]): r for r in got}
    assert len(by) == len(rows)
    assert by["a", 8]["vol_sum_10tick"] is None and by["b", 8]["vol_sum_10tick"] is None
    assert by["b", 9]["vol_sum_10tick"] == sum(2 * (i % 7 + 1.0) for i in range(10))
    assert by["c", 48]["vol_sum_50tick"] is None and by["d", 48]["vol_sum_50tick"] is None
    assert by["d", 50]["vol_sum_50tick"] == sum(2 * (i % 7 + 1.0) for i in range(1, 51))
    assert by["d", 0]["delta_t_ms"] is None and by["d", 30]["delta_t_ms"] == 1
    assert by["d", 51]["target_return"] is None and by["d", 0]["target_return"] == 1.0
    complete = complete_tick_rows(
        tick_features(df, "isin", "t", ["id"], "price", "size", spread=spread)
    )
    assert sorted(r["id"] for r in complete.collect()) == [49, 50]


@pytest.mark.parametrize("spread", [DEFAULT, Spread(20, 6, 50)], ids=["whole", "bins"])
def test_split_and_gate(spark, spread):
    rows = [(k, i // 2, i) for k, n in [("a", 99), ("b", 100), ("c", 101)] for i in range(n)]
    df = spark.createDataFrame(rows, "isin string, t long, id long")
    got = chrono_split(df, "isin", "t", ["id"], validation=0.25, spread=spread).collect()
    assert {r["isin"] for r in got} == {"b", "c"}
    assert sorted(r["id"] for r in got if r["isin"] == "c" and r["is_train"]) == list(range(80))
    assert sorted(r["id"] for r in got if r["isin"] == "b" and r["is_validation"]) == list(range(60, 80))
    assert not any(r["is_validation"] and not r["is_train"] for r in got)
