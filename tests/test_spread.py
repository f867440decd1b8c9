"""Bins and seeds on groups with one dominant key, against plain windows."""

import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from tickweave.operators.asof import Lookup, asof_join
from tickweave.operators.spread import (
    BIN, HOT, SEED, Spread, of_likely_large, running_totals, with_bins, with_neighbour_rows,
)

SCHEMA = "key string, t long, id long, x long"


def skewed_rows(n=400, seed=3):
    """One key with a third of the rows, half of those in one short burst."""
    random.seed(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{random.randrange(25)}"
        t = random.randrange(1000, 1020) if i % 2 else random.randrange(1_000_000)
        rows.append((key, t, i, random.randrange(10)))
    rows += [(None, 5, n + 1, 1), (None, 6, n + 2, 2), ("hot", None, n + 3, 4)]
    return rows


def test_bins_follow_the_axis_and_stay_small(spark):
    df = spark.createDataFrame(skewed_rows(3000), SCHEMA)
    rows = with_bins(df, ["key"], "t", Spread(200, 50, 10)).collect()
    assert len(rows) == 3003
    hot = [r for r in rows if r["key"] == "hot" and r["t"] is not None]
    assert all(r[HOT] for r in hot) and not any(r[HOT] for r in rows if r["key"] == "k1")
    ordered = sorted(hot, key=lambda r: r["t"])
    assert [r[BIN] for r in ordered] == sorted(r[BIN] for r in hot)
    sizes = {}
    for r in hot:
        sizes[r[BIN]] = sizes.get(r[BIN], 0) + 1
    # The burst of 500 rows sits on 20 instants: it is split down to them.
    assert max(sizes.values()) <= 120
    assert {r[BIN] for r in rows if r["key"] == "k1"} == {0}


def test_null_keys_form_a_group(spark, small_bins):
    df = spark.createDataFrame([(None, i, i, 1) for i in range(40)], SCHEMA)
    got = running_totals(df, ["key"], "t", [F.col("t")], {"n": F.lit(1)}, small_bins).collect()
    assert sorted(r["n"] for r in got) == list(range(1, 41))
    assert {r["n_total"] for r in got} == {40}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from("abc"), st.integers(0, 40), st.integers(-5, 5)),
        min_size=1, max_size=80,
    )
)
def test_running_totals_equal_plain_window(spark, values):
    rows = [(k, t, i, x) for i, (k, t, x) in enumerate(values)]
    df = spark.createDataFrame(rows, SCHEMA)
    order = [F.col("t"), F.col("id")]
    w = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = {
        (r["id"], r["s"], r["n"])
        for r in df.select("id", F.sum("x").over(w).alias("s"), F.sum("x").over(Window.partitionBy("key")).alias("n")).collect()
    }
    got = running_totals(df, ["key"], "t", order, {"s": F.col("x")}, Spread(5, 3, 100)).collect()
    assert {(r["id"], r["s"], r["s_total"]) for r in got} == want


@pytest.mark.parametrize("reach", [1, 4, 30])
def test_neighbour_rows_reach_over_many_bins(spark, small_bins, reach):
    df = spark.createDataFrame(skewed_rows(), SCHEMA).where("key is not null and t is not null")
    rows = with_neighbour_rows(df, ["key"], "t", ["id"], reach, 1, small_bins)
    w = Window.partitionBy("key", BIN).orderBy("t", "id")
    got = rows.select(
        "id", SEED,
        F.sum("x").over(w.rowsBetween(-reach, 0)).alias("s"),
        F.count("x").over(w.rowsBetween(-reach, 0)).alias("n"),
        F.lead("id").over(w).alias("after"), F.lag("id").over(w).alias("ahead"),
    ).where(F.col(SEED) == 0).drop(SEED)
    p = Window.partitionBy("key").orderBy("t", "id")
    want = df.select(
        "id",
        F.sum("x").over(p.rowsBetween(-reach, 0)).alias("s"),
        F.count("x").over(p.rowsBetween(-reach, 0)).alias("n"),
        F.lead("id").over(p).alias("after"), F.lag("id").over(p).alias("ahead"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bins_on_fractional_axis(spark, small_bins):
    rows = [("a", math.sin(i), i) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, score double, id long")
    got = running_totals(df, ["key"], "score", [F.col("score")], {"n": F.lit(1)}, small_bins).collect()
    ranked = sorted(got, key=lambda r: r["score"])
    assert [r["n"] for r in ranked] == list(range(1, 101))


def test_plans_without_large_groups_shuffle_once(spark):
    df = spark.createDataFrame([("a", 1, 1, 1)], SCHEMA)
    run = running_totals(df, ["key"], "t", [F.col("t")], {"n": F.lit(1)})
    near = with_neighbour_rows(df, ["key"], "t", ["id"], 5, 1)
    near = near.withColumn("x", F.lag("x").over(Window.partitionBy("key", BIN).orderBy("t")))
    looked = asof_join(
        df, [Lookup(df.select("key", "t", F.col("x").alias("y")), "t", ["y"])], "t", ["key"], "forward"
    )
    for plan in [run, near, looked]:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def tied_rows(n=900):
    """A third of the rows of one key at one instant, and most of those with one and the same order."""
    random.seed(5)
    rows = []
    for i in range(n):
        key = "hot" if i % 2 else f"k{random.randrange(25)}"
        t = 1000 if i % 3 == 0 else random.randrange(1_000_000)
        rows.append((key, t, i, i % 10))
    return rows + [("hot", None, n + i, 3) for i in range(60)] + [("still", 7, n + 60 + i, 1) for i in range(200)]


def test_ties_are_parted_along_their_order(spark):
    df = spark.createDataFrame(tied_rows(6000), SCHEMA)
    rows = with_bins(df, ["key"], "t", Spread(200, 50, 10), ["id"]).collect()
    assert len(rows) == 6260 and {r["key"] for r in rows if r[HOT]} == {"hot", "still"}
    for key in ("hot", "still"):
        ordered = sorted((r for r in rows if r["key"] == key), key=lambda r: (r["t"] is not None, r["t"] or 0, r["id"]))
        assert [r[BIN] for r in ordered] == sorted(r[BIN] for r in ordered)
        sizes = Counter(map(tuple, (r[BIN] for r in ordered)))
        assert max(sizes.values()) < 100, sizes.most_common(3)


def test_equal_order_values_end_the_cuts(spark):
    """Few values with very many rows each, beside rare ones: cut apart, then left whole."""
    rows = [("a", 1, 5 if i % 50 else i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = with_bins(df, ["key"], "t", Spread(100, 10, 10), ["id"]).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(tuple(r[BIN]), []).append(r["id"])
    assert len(got) == 3000 and all(len(ids) < 20 or len(set(ids)) == 1 for ids in sizes.values())


@pytest.mark.parametrize("limits", [Spread(20, 7, 500), Spread(20, 7, 1), Spread(100, 40, 500)])
def test_totals_and_neighbours_with_ties_and_without_time(spark, limits):
    df = spark.createDataFrame(tied_rows(), SCHEMA)
    p = Window.partitionBy("key").orderBy("t", "id")
    run = p.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("x").over(run).alias("s"), F.lag("id", 3).over(p), F.lead("id").over(p)).collect()
    totals = running_totals(df, ["key"], "t", [F.col("t"), F.col("id")], {"s": F.col("x")}, limits, ["id"])
    assert sorted((r["id"], r["s"]) for r in totals.collect()) == sorted((r["id"], r["s"]) for r in want)
    w = Window.partitionBy("key", BIN).orderBy("t", "id")
    near = with_neighbour_rows(df, ["key"], "t", ["id"], 3, 1, limits)
    near = near.select("id", F.lag("id", 3).over(w), F.lead("id").over(w), SEED).where(F.col(SEED) == 0).collect()
    assert sorted((r[0], r[1] or -1, r[2] or -1) for r in near) == sorted((r[0], r[2] or -1, r[3] or -1) for r in want)


def test_rows_without_time_come_first_in_bins(spark, small_bins):
    df = spark.createDataFrame([("a", i or None, i, 1) for i in range(100)], SCHEMA)
    got = running_totals(df, ["key"], "t", [F.col("t")], {"n": F.lit(1)}, small_bins).collect()
    assert sorted((r["id"], r["n"]) for r in got) == [(i, i + 1) for i in range(100)]


def test_small_groups_are_seen_in_a_sample_only(spark):
    """Only rows of groups that a sample shows as large are counted; nulls are a group."""
    limits = Spread(8_000, 4_000, 10)
    df = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"),
        F.col("id").alias("t"), "id",
    )
    rows = of_likely_large(df, ["key"], limits)
    assert [tuple(r) for r in rows.groupBy("key").count().collect()] == [(None, 20_000)]
    assert of_likely_large(df.where("key is not null"), ["key"], limits) is None
    bins = with_bins(df, ["key"], "t", limits).where(HOT).groupBy("key", BIN).count().collect()
    assert len(bins) == 5 and sum(r["count"] for r in bins) == 20_000
