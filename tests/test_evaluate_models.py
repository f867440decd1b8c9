import datetime as dt
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tickweave.operators.evaluate import (
    auc_by_key, best_fbeta, metrics_by_key, pr_curve_by_key, signal_returns, strategy_report,
    trade_signals,
)
from tickweave.operators.models import (
    fit_breakout_model, fit_return_model, score_rows,
)
from tickweave.operators.spread import DEFAULT, Spread

SCHEMA = "isin string, target_label int, score double"
SPREADS = pytest.mark.parametrize("spread", [DEFAULT, Spread(5, 3, 50)], ids=["whole", "bins"])


def by_threshold(rows, beta=0.5):
    """Best (f, threshold, precision, recall) by trying every threshold."""
    positives = sum(y for y, _ in rows)
    best = None
    for limit in sorted({s for _, s in rows}):
        picked = [y for y, s in rows if s >= limit]
        p, r = sum(picked) / len(picked), sum(picked) / positives
        f = (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0
        if best is None or f > best[0] + 1e-12:
            best = (f, limit, p, r)
    return best


@SPREADS
def test_auc_and_threshold(spark, spread):
    random.seed(5)
    rows = [("a", random.randrange(2), random.randrange(8) / 8) for _ in range(60)]
    rows += [("b", int(i > 6), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    auc = {r["isin"]: r["auc"] for r in auc_by_key(df, "isin", "target_label", "score", spread).collect()}
    ml = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="target_label", numBins=0
    )
    assert auc["b"] == 1.0
    assert auc["a"] == pytest.approx(ml.evaluate(df.where("isin = 'a'")))
    best = {r["isin"]: r for r in best_fbeta(df, "isin", "target_label", "score", spread=spread).collect()}
    for key in "ab":
        _, limit, p, r = by_threshold([(y, s) for k, y, s in rows if k == key])
        assert (best[key]["threshold"], best[key]["precision"], best[key]["recall"]) == pytest.approx((limit, p, r))


@SPREADS
def test_one_class_and_no_signal(spark, spread):
    df = spark.createDataFrame(
        [("none", 0, 0.1), ("none", 0, 0.2), ("all", 1, 0.9), ("all", 1, 0.1), ("mix", 1, 0.4), ("mix", 0, 0.3)],
        SCHEMA,
    ).withColumns({"buy_price": F.lit(10.0), "sell_price": F.lit(11.0), "total_rows": F.lit(5),
                   "d": F.lit(dt.date(2024, 5, 2))})
    metrics = metrics_by_key(pr_curve_by_key(df, "isin", "target_label", "score", spread), "isin")
    got = {r["isin"]: (r["auc"], r["threshold"], r["precision"], r["recall"]) for r in metrics.collect()}
    assert got == {"none": (0.0, 0.5, 0.0, 0.0), "all": (0.0, 0.5, 0.0, 0.0), "mix": (1.0, 0.4, 1.0, 1.0)}
    signals = trade_signals(df, metrics, "isin", "score")
    returns = signal_returns(signals, "isin", F.col("d"))
    totals = df.groupBy("isin").agg(F.max("total_rows").alias("total_rows"))
    report = strategy_report(metrics, returns, totals, "isin").collect()
    assert [r["ISIN"] for r in report] == ["mix", "all", "none"]
    first, last = report[0].asDict(), report[-1].asDict()
    assert first["Base_Breakout_Frequency"] == "50.00%" and first["Optimal_Threshold"] == "0.4000"
    assert first["Test_Set_Avg_PnL_Percent"] == 10.0 and first["Signal_Dates"] == "2024-05-02"
    assert last["Test_Set_Avg_PnL_Percent"] == 0.0 and last["Signal_Dates"] == "None"
    assert last["Model_Precision (F0.5)"] == "0.00%"


@SPREADS
def test_thresholds_of_other_rows(spark, spread):
    from tickweave.plans.breakout import BreakoutStudy

    random.seed(7)
    rows = [
        (k, i, random.randrange(2) if k != "empty" else 0, random.randrange(9) / 9, i < 40)
        for k in ("a", "b", "empty") for i in range(80)
    ] + [("new", i, i % 2, i / 9, False) for i in range(9)] + [("high", 0, 1, 0.9, True), ("high", 1, 0, 0.1, True), ("high", 2, 1, 0.2, False)]
    df = spark.createDataFrame(rows, "isin string, i int, target_label int, score double, is_validation boolean").withColumns(
        {"tradeTime": F.timestamp_seconds("i"), "total_rows": F.lit(100), "buy_price": F.lit(1.0), "sell_price": F.lit(1.5)}
    )
    study = BreakoutStudy(zone=None, spread=spread)
    found = {r["ISIN"]: r.asDict() for r in study.report(df, threshold_on="validation").collect()}
    for key in ("a", "b", "empty", "new", "high"):
        seen = [(y, s) for k, _, y, s, v in rows if k == key and v]
        test = [(y, s) for k, _, y, s, v in rows if k == key and not v]
        limit = by_threshold(seen)[1] if 0 < sum(y for y, _ in seen) < len(seen) else 0.5
        picked = [y for y, s in test if s >= limit]
        assert found[key]["Optimal_Threshold"] == f"{limit:.4f}"
        assert found[key]["Test_Set_Ticks"] == len(test)
        assert found[key]["Model_Precision (F0.5)"] == f"{100 * sum(picked) / max(len(picked), 1):.2f}%"
        assert found[key]["Model_Recall"] == f"{100 * sum(picked) / max(sum(y for y, _ in test), 1):.2f}%"
        assert found[key]["Test_Set_Avg_PnL_Percent"] == (50.0 if picked else 0.0)
    assert found["high"]["Signal_Dates"] == "None"
    plain = df.where("not is_validation")
    assert study.report(df).collect() == study.report(plain).collect()
    with pytest.raises(ValueError):
        study.report(df, threshold_on="train")


def study_rows(spark, n=120):
    random.seed(9)
    rows = []
    for key in "ab":
        for i in range(n):
            x = random.random()
            rows.append((key, x, random.random(), int(x > 0.5), x * 2, i >= n * 0.8))
    return spark.createDataFrame(rows, "isin string, x double, z double, y int, r double, late boolean")


def test_pooled_models_learn(spark):
    df = study_rows(spark)
    model = fit_breakout_model(df, ["x", "z"], "y", "late", rounds=3)
    scored = score_rows(model, df)
    assert scored.columns == [*df.columns, "score"]
    assert auc_by_key(scored, "isin", "y", "score").agg(F.min("auc")).first()[0] > 0.95
    fitted = score_rows(fit_return_model(df, ["x", "z"], "r", rounds=3), df)
    assert fitted.agg(F.corr("r", "score")).first()[0] > 0.95


def test_studies_fit_every_key(spark, tmp_path):
    from tickweave.operators.boosting import Boosting, score_by_key
    from tickweave.operators.model_store import load_models
    from tickweave.operators.models import BREAKOUT_FEATURES, RETURN_FEATURES
    from tickweave.plans import returns
    from tickweave.plans.breakout import BreakoutStudy

    random.seed(2)
    rows = []
    for key, n in [("good", 150), ("noise", 150), ("few", 20), ("broken", 150)]:
        for i in range(n):
            x = random.random()
            label = int(x > 0.5) if key == "good" else random.randint(0, 1)
            rows.append((key, i, "t", x, label, float("inf") if key == "broken" and i == 7 else x))
    df = spark.createDataFrame(rows, "isin string, i int, TVTIC string, a double, target_label int, target_return double")
    df = df.withColumn("tradeTime", F.timestamp_seconds("i"))
    for name in dict.fromkeys([*BREAKOUT_FEATURES, *RETURN_FEATURES]):
        df = df.withColumn(name, F.col("a"))
    how = Boosting(rounds=12, step=0.3, depth=2, logistic=True, patience=3)
    path = str(tmp_path / "b")
    manifest, scored = BreakoutStudy(zone=None).fit_every_key(df, path, how, min_auc=0.9)
    found = {r.isin: r for r in manifest.collect()}
    assert {k: r.status for k, r in found.items()} == {"good": "saved", "noise": "rejected", "few": "skipped", "broken": "rejected"}
    assert found["good"].auc > 0.9 and found["few"].auc is None and found["noise"].run <= 12
    assert [r.isin for r in load_models(spark, path, "isin").collect()] == ["good"]
    assert scored.groupBy("isin").count().count() == 3
    again, both = BreakoutStudy(zone=None).fit_every_key(df, path, how, min_auc=0.9, score_validation=True)
    assert {r.isin: r.auc for r in again.collect()} == {k: r.auc for k, r in found.items()}
    assert both.where("is_validation").groupBy("isin").count().count() == 3
    assert both.where("not is_train").count() == scored.count() and both.where("is_validation and not is_train").count() == 0
    path = str(tmp_path / "r")
    manifest = returns.fit_every_key(df, "isin", path, how=Boosting(rounds=3, depth=2))
    status = {r.isin: (r.status, r.rounds, r.error is None) for r in manifest.collect()}
    assert status == {"good": ("saved", 3, True), "noise": ("saved", 3, True), "few": ("skipped", 0, True), "broken": ("failed", 0, False)}
    again = score_by_key(df, load_models(spark, path, "isin"), "isin", RETURN_FEATURES, Boosting(rounds=3, depth=2))
    assert again.count() == 300
