import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.llm.vantage import distances, nearest, plant


def brute(rows, is_query, k):
    real = {}
    for key, v in rows:
        if key is None or v is None or any(c is None or not np.isfinite(c) for c in v) or not any(v) or len(v) != 4:
            continue
        real[key] = min(real.get(key, v), v)
    out = {}
    for q, v in real.items():
        if is_query(q):
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), key) for key, w in real.items() if key != q)
            out[q] = [(k + 1, key, score) for k, (score, key) in enumerate(near[:k])]
    return out


def run(df, **kw):
    got = {}
    for r in nearest(df, F.col("vec_id") % 7 == 0, k=5, **kw).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(rows) for q, rows in got.items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("rows_per_shard", [40, 10_000])
def test_factor_one_is_exact_with_ties_copies_and_bad_rows(spark, rows_per_shard):
    rng = np.random.default_rng(1)
    rows = [(k, rng.integers(-3, 4, 4).astype(float).tolist()) for k in range(400)]
    rows += [(k, [1.0, 2.0, 0.0, 1.0]) for k in range(-60, 0)]
    rows += [(7, [9.0] * 4), (14, rows[14][1]), (None, [1.0] * 4), (1001, None), (1002, []), (1003, [0.0] * 4)]
    rows += [(1008, [1.0, None, 1.0, 1.0]), (1015, [1.0, float("nan"), 1.0, 1.0]), (1022, [float("inf")] * 4), (1029, [1.0] * 3)]
    want = brute(rows, lambda q: q % 7 == 0, 5)
    got = run(frame(spark, rows), factor=1.0, rows_per_shard=rows_per_shard, queries_per_task=10, max_sample=200)
    assert got == want and len(want) > 50


def test_few_rows_and_none(spark):
    assert run(frame(spark, [])) == {}
    assert run(frame(spark, [(7, [1.0, 1.0])])) == {}
    got = run(frame(spark, [(7, [1.0, 1.0]), (8, [4.0, 5.0]), (14, [1.0, 1.0])]))
    assert got == {7: [(1, 14, 0.0), (2, 8, 5.0)], 14: [(1, 7, 0.0), (2, 8, 5.0)]}


def test_larger_factors_keep_recall_on_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    x = centres[rng.integers(0, 6, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    df = frame(spark, [(k, v.tolist()) for k, v in enumerate(x)])
    queries = np.arange(0, 1500, 7)
    away = distances(x[queries], x)
    away[np.arange(len(queries)), queries] = np.inf
    want = {int(q): set(np.argsort(a)[:5].tolist()) for q, a in zip(queries, away)}
    got = run(df, rows_per_shard=200, max_sample=500)
    found = sum(len({v for _, v, _ in got[q]} & near) for q, near in want.items())
    assert found / (5 * len(want)) >= 0.9


def test_trees_hold_every_row_once_even_if_all_are_equal():
    for x in (np.ones((500, 3)), np.repeat(np.eye(3), 200, axis=0), np.random.default_rng(3).normal(size=(700, 3))):
        tree = plant(x, 16)
        assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(len(x)))
        leaf = tree.locate(x)
        for k, rows in enumerate(tree.leaves):
            assert set(np.flatnonzero(leaf == k)) == set(rows.tolist())
