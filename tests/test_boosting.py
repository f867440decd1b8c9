"""One model per security: learning, early stopping, blocks against whole securities, the store."""

import random

import pytest
from pyspark.sql import functions as F

from tickweave.operators.boosting import Boosting, best_rounds, fit_rounds, models, score_by_key
from tickweave.operators.model_store import load_models, save_models

SCHEMA = "isin string, x double, z double, y int, r double, late boolean"


def study_rows(spark, n=200, keys="ab"):
    random.seed(9)
    rows = []
    for key in keys:
        for i in range(n):
            x, z = random.random(), random.choice([None, random.random()])
            rows.append((key, x, z, int((x > 0.5) != (key == "b")), 3 * x, i >= n * 0.8))
    return spark.createDataFrame(rows, SCHEMA)


def fitted(df, label, how, valid=None):
    known, rounds = fit_rounds(df, "isin", ["x", "z"], label, valid, how)
    return known, rounds, models(known, rounds, "isin", how)


def test_each_security_learns_its_own_rule(spark):
    df = study_rows(spark)
    how = Boosting(rounds=20, step=0.3, depth=2, logistic=True)
    _, rounds, found = fitted(df, "y", how)
    scored = score_by_key(df, found, "isin", ["x", "z"], how)
    wrong = scored.where((F.col("score") > 0.5).cast("int") != F.col("y")).count()
    assert scored.columns == [*df.columns, "score"] and wrong < 12
    assert rounds.groupBy("isin").count().collect() and found.where("round = 20 and run = 20").count() == 2
    how = Boosting(rounds=30, step=0.3, depth=3)
    scored = score_by_key(df, fitted(df, "r", how)[2], "isin", ["x", "z"], how)
    assert scored.agg(F.max(F.abs(F.col("score") - F.col("r")))).first()[0] < 0.4


@pytest.mark.parametrize("logistic", [True, False])
def test_blocks_build_the_trees_of_whole_securities(spark, logistic):
    df = study_rows(spark, 130)
    label, trees = "y" if logistic else "r", []
    for block_rows in (1000, 40):
        how = Boosting(rounds=2, depth=2, bins=8, min_leaf=5, logistic=logistic, patience=2, block_rows=block_rows)
        _, rounds, found = fitted(df, label, how, "late")
        trees.append({(r.isin, r.round): r for r in rounds.collect()})
        scored = score_by_key(df, found, "isin", ["x", "z"], how)
        trees[-1]["scores"] = sorted((r.isin, r.x, round(r.score, 9)) for r in scored.collect())
    whole, parts = trees
    assert whole.keys() == parts.keys() and whole.pop("scores") == parts.pop("scores")
    for at, row in whole.items():
        assert (row.feature, row.cut) == (parts[at].feature, parts[at].cut)
        assert row.value == pytest.approx(parts[at].value) and row.loss == pytest.approx(parts[at].loss)


def test_patience_stops_and_keeps_the_best_round(spark):
    random.seed(3)
    rows = [("noise", random.random(), 0.0, random.randint(0, 1), 0.0, i >= 150) for i in range(200)]
    rows += [("rule", x := random.random(), 0.0, int(x > 0.5), 0.0, i >= 150) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    how = Boosting(rounds=60, step=0.3, logistic=True, patience=10, min_leaf=5)
    _, rounds, _ = fitted(df, "y", how, "late")
    loss = {}
    for r in rounds.collect():
        loss.setdefault(r.isin, {})[r.round] = r.loss
    best = {r.isin: (r.best, r.run) for r in best_rounds(rounds, "isin").collect()}
    for key, by_round in loss.items():
        least = min(by_round, key=lambda k: (by_round[k], k))
        assert best[key] == (least, max(by_round)) and best[key][1] == min(60, least + 10)
    assert best["noise"][1] < 60


def test_failed_and_odd_securities(spark):
    rows = [("nan", 0.1 * k, 1.0, 0, float("nan") if k == 3 else 1.0, False) for k in range(30)]
    rows += [("flat", 1.0, None, 1, 2.0, False) for _ in range(30)]
    how = Boosting(rounds=3, depth=2, logistic=False)
    df = spark.createDataFrame(rows, SCHEMA)
    _, rounds, found = fitted(df, "r", how)
    failed = rounds.where("error is not null").collect()
    assert [(r.isin, r.round) for r in failed] == [("nan", 0)] and "finite" in failed[0].error
    scored = score_by_key(df, found, "isin", ["x", "z"], how).collect()
    assert {(r.isin, r.score) for r in scored} == {("flat", 2.0)}
    assert fitted(df.limit(0), "r", how)[2].count() == 0


def test_store_keeps_what_passed_its_gate(spark, tmp_path):
    df = study_rows(spark, 60)
    how = Boosting(rounds=2, depth=1, min_leaf=5)
    _, _, found = fitted(df, "r", how)
    path = str(tmp_path / "store")
    verdict = spark.createDataFrame([("a", "saved", 0.7), ("b", "rejected", 0.5), ("c", "skipped", None)], "isin string, status string, auc double")
    save_models(found, verdict, path, "isin")
    assert [r.isin for r in load_models(spark, path, "isin").collect()] == ["a"]
    later = spark.createDataFrame([("b", "saved", 0.9), ("a", "rejected", 0.4)], "isin string, status string, auc double")
    save_models(found, later, path, "isin")
    kept = load_models(spark, path, "isin")
    assert sorted(r.isin for r in kept.collect()) == ["a", "b"]  # a keeps its earlier model
    assert score_by_key(df, kept.drop("run_id"), "isin", ["x", "z"], how).count() == 120


def test_securities_fitted_together_get_the_trees_of_each_alone(spark):
    df = study_rows(spark, 90, "abcdefgh")
    how = Boosting(rounds=4, depth=3, bins=8, min_leaf=5, logistic=True, patience=2)
    whole = {(r.isin, r.round): r for r in fitted(df, "y", how, "late")[1].collect()}
    for key in "ac":
        alone = fitted(df.where(F.col("isin") == key), "y", how, "late")[1].collect()
        assert len(alone) == sum(k == key for k, _ in whole)
        for r in alone:
            assert r[2:] == whole[key, r.round][2:]


def test_a_batch_and_blocks_take_few_jobs(spark):
    """Securities of a batch are one group of a task; a level of blocks is one job without a write."""
    from tickweave.operators import boosting

    counted, made = boosting.stage, []
    boosting.stage = lambda df: made.append(1) or counted(df)
    try:
        how = Boosting(rounds=6, depth=2, bins=8, min_leaf=5, block_rows=40)
        _, rounds, _ = fitted(study_rows(spark, 130), "r", how)
    finally:
        boosting.stage = counted
    assert rounds.groupBy("isin").count().where("count = 6").count() == 2
    assert len(made) <= 4  # 6 rounds of 2 levels were 26 writes


@pytest.mark.parametrize("few", [0, 500])
def test_pooled_return_model_in_blocks(spark, monkeypatch, few):
    from tickweave.operators import boosting
    from tickweave.operators.models import fit_return_model, save_model, score_rows

    monkeypatch.setattr(boosting, "FEW_SUMS", few)
    monkeypatch.setattr(boosting, "ROUNDS_KEPT", 2)
    monkeypatch.setattr(boosting, "IN_BLOCK", 50)
    df = study_rows(spark, 150)
    found = []
    for block_rows in (1000, 100):
        model = fit_return_model(df, ["x", "z"], "r", rounds=3, depth=3, block_rows=block_rows)
        scored = score_rows(model, df)
        assert scored.columns == [*df.columns, "score"]
        found.append(sorted((r.isin, r.x, round(r.score, 9)) for r in scored.collect()))
        assert scored.agg(F.avg("score") - F.avg("r")).first()[0] == pytest.approx(0, abs=1e-9)
    assert found[0] == found[1]
    with pytest.raises(ValueError):
        fit_return_model(df.limit(0), ["x", "z"], "r", rounds=1)


@pytest.fixture
def plan_texts(spark):
    """Lengths of the texts of all plans that ran since the test began."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def known():
        bus.waitUntilEmpty()
        found = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executionsList())
        return {e.executionId(): len(e.physicalPlanDescription()) for e in found}

    before = known()
    return lambda: [n for k, n in known().items() if k not in before]


def test_plans_stay_short_over_many_rounds_in_blocks(spark, plan_texts):
    """Each round once cached a plan that held the one before twice: its text doubled up to the driver's memory."""
    _, rounds, _ = fitted(study_rows(spark, 130), "r", Boosting(rounds=9, depth=1, bins=8, min_leaf=5, block_rows=40))
    assert rounds.groupBy("isin").count().where("count = 9").count() == 2
    assert 0 < max(plan_texts()) < 60_000


def test_plans_of_the_pooled_model_stay_short(spark, plan_texts):
    from tickweave.operators.models import fit_return_model, score_rows

    df = study_rows(spark, 150)
    model = fit_return_model(df, ["x", "z"], "r", rounds=9, depth=1, block_rows=100)
    assert model.fitted.where("run = 9").count() == 1
    mean = score_rows(model, df).agg(F.avg("score") - F.avg("r")).first()[0]
    assert mean == pytest.approx(0, abs=1e-9) and 0 < max(plan_texts()) < 60_000


def test_securities_in_blocks_stop_early_with_short_plans(spark, monkeypatch, plan_texts):
    """Scores worked out from all trees, after some securities have stopped, are those of round after round."""
    from tickweave.operators import boosting

    random.seed(5)
    rows = [("noise", random.random(), 0.0, random.randint(0, 1), 0.0, i >= 100) for i in range(130)]
    rows += [("rule", x := random.random(), 0.0, int(x > 0.5), 0.0, i >= 100) for i in range(130)]
    df, found = spark.createDataFrame(rows, SCHEMA), []
    for block_rows, kept in ((1000, 50), (40, 50), (40, 3)):
        monkeypatch.setattr(boosting, "ROUNDS_KEPT", kept)
        how = Boosting(rounds=10, step=0.3, depth=1, bins=8, min_leaf=5, logistic=True, patience=3, block_rows=block_rows)
        got = fitted(df, "y", how, "late")[1].collect()
        found.append(sorted((r.isin, r.round, r.feature, r.cut, round(r.loss, 9), [round(v, 9) for v in r.value]) for r in got))
    assert found[0] == found[1] == found[2]
    last = {isin: k for isin, k, *_ in found[0]}
    assert last["noise"] < last["rule"] == 10 and max(plan_texts()) < 60_000
