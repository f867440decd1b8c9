"""Every catalog query against its SQL twin, with and without bins."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect
from tickweave.operators.spread import Spread
from tickweave.plans import catalog
from tickweave.plans.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"
BINNED = [
    "cancelled_pairs", "last_day_position", "tick_window_features", "asof_backward_nokey",
    "asof_forward_key", "asof_backward_key", "benchmark_delta", "future_target",
    "chronological_split", "pr_curve", "auc_by_key",
]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert compare(got, duck.execute(entry.oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", BINNED)
def test_matches_sql_with_bins(spark, duck, name, monkeypatch):
    monkeypatch.setattr(catalog, "SPREAD", Spread(min_rows=20, rows_per_bin=7, max_groups=500))
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert compare(got, duck.execute(entry.oracle_sql()[name]).df()) is None


def test_entry(spark):
    flagship = entry.entry(spark)
    assert flagship.count() > 0
    assert flagship.columns[:3] == ["isin", "price", "total_size"]


def test_names_fit():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) - set(ORACLE) <= {"breakout_model"}
