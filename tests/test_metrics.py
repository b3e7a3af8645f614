from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from riskframe.operators import classify, metrics

FIVE = [(0.9, 0), (0.9, 1), (0.7, 1), (0.6, 0), (0.5, 1)]


@pytest.fixture(scope="module")
def five(spark):
    df = spark.createDataFrame(FIVE, "score double, y int")
    return df.withColumn("p", (F.col("score") > 0.65).cast("int"))


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(5)
    score = np.round(rng.beta(2, 5, 3000), 3)
    y = (rng.random(3000) < score).astype(int)
    rows = [(float(s), int(v), int(g)) for s, v, g in zip(score, y, rng.integers(0, 3, 3000))]
    return rows, spark.createDataFrame(rows, "score double, y int, g int")


def test_golden_rows(five):
    row = metrics.binary_metrics(five, "y", "p", "score").first()
    assert row.asDict() == pytest.approx(
        {
            "acc": 0.6, "prec0": 0.5, "prec1": 2 / 3, "rec0": 0.5, "rec1": 2 / 3, "auroc": 0.416667,
            "auprc": 0.627778, "minpse": 2 / 3, "f1scores": 2 / 3,
        },
        abs=1e-6,
    )
    cells = {(r["label"], r["prediction"]): r["rows"] for r in metrics.confusion_matrix(five, "y", "p").collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 2}
    assert metrics.cohen_kappa(five, "y", "p").first()["kappa"] == pytest.approx(0.166667, abs=1e-6)
    areas = metrics.curve_areas(five, "y", "score", only=["average_precision"]).first()
    assert areas["average_precision"] == pytest.approx(0.588889, abs=1e-6)
    weights = {r["y"]: r["weight"] for r in classify.balanced_weights(five, "y").collect()}
    assert weights == pytest.approx({0: 1.25, 1: 0.833333}, abs=1e-6)


def test_golden_curves(five):
    roc = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_curve(five, "y", "score").collect())
    assert np.allclose(roc, [(0, 0), (0.5, 1 / 3), (0.5, 2 / 3), (1, 2 / 3), (1, 1)])
    pr = sorted((r["recall"], r["precision"]) for r in metrics.pr_curve(five, "y", "score").collect())
    assert np.allclose(pr, [(0, 1), (1 / 3, 0.5), (2 / 3, 0.5), (2 / 3, 2 / 3), (1, 0.6)])


def test_areas_against_spark_and_by_symmetry(many):
    _, df = many
    area = metrics.curve_areas(df, "y", "score", only=["auroc"]).first()["auroc"]
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0)
    assert area == pytest.approx(evaluator.evaluate(df), abs=1e-9)
    flipped = df.withColumn("score", 1 - F.col("score"))
    assert metrics.curve_areas(flipped, "y", "score", only=["auroc"]).first()["auroc"] == pytest.approx(1 - area)


def test_groups_are_judged_apart(many):
    rows, df = many
    found = {r["g"]: r["auroc"] for r in metrics.curve_areas(df, "y", "score", ["g"]).collect()}
    for g in range(3):
        pos = [s for s, y, k in rows if k == g and y]
        neg = [s for s, y, k in rows if k == g and not y]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert found[g] == pytest.approx(wins / (len(pos) * len(neg)))


def test_grid_equals_numpy_interpolation(many):
    rows, df = many
    found = metrics.roc_grid(df, "y", "score", ["g"]).collect()
    assert len(found) == 300
    for g in range(3):
        scores = np.array([s for s, _, k in rows if k == g])
        y = np.array([v for _, v, k in rows if k == g])
        fpr, tpr = [0.0], [0.0]
        for t in sorted(set(scores), reverse=True):
            fpr.append(((scores >= t) & (y == 0)).sum() / (y == 0).sum())
            tpr.append(((scores >= t) & (y == 1)).sum() / (y == 1).sum())
        expected = np.interp(np.linspace(0, 1, 100), fpr, tpr)
        expected[0] = 0.0
        got = [r["tpr"] for r in sorted((r for r in found if r["g"] == g), key=lambda r: r["grid"])]
        assert got == pytest.approx(expected, abs=1e-9)


def test_mean_curve(many):
    _, df = many
    grid = metrics.roc_grid(df, "y", "score", ["g"])
    mean = sorted(metrics.roc_mean(grid).collect(), key=lambda r: r["grid"])
    by_fold = {}
    for r in grid.collect():
        by_fold.setdefault(r["grid"], []).append(r["tpr"])
    expected = np.array([np.mean(by_fold[k]) for k in range(100)])
    expected[-1] = 1.0
    assert [r["mean_tpr"] for r in mean] == pytest.approx(expected)
    assert [r["std_tpr"] for r in mean] == pytest.approx([np.std(by_fold[k]) for k in range(100)])
    area = metrics.roc_mean_area(metrics.roc_mean(grid)).first()["mean_auc"]
    assert area == pytest.approx(np.trapezoid(expected, np.linspace(0, 1, 100)))
    assert all(0 <= r["lower"] <= r["upper"] <= 1 for r in mean)


def test_one_sided_groups_give_null_not_an_error(spark):
    df = spark.createDataFrame([(0.2, 1, 1, 1), (0.4, 1, 1, 1)], "score double, y int, p int, g int")
    row = metrics.binary_metrics(df, "y", "p", "score", ["g"]).first()
    assert row["auroc"] is None and row["prec0"] is None and row["prec1"] == 1.0
    report = {r["class"]: r["f1"] for r in metrics.classification_report(df, "y", "p").collect()}
    assert report["0"] == 0.0 and report["1"] == 1.0


def test_soft_scores(five, spark):
    row = metrics.soft_fbeta(five, "y", "score").first()
    # every score rounds to 1 (0.5 to 0): predicted 4, true positives 2 of 3
    assert (row["precision"], row["recall"]) == pytest.approx((0.5, 2 / 3), abs=1e-6)
    none = spark.createDataFrame([(0.9, 0)], "score double, y int")
    assert metrics.soft_fbeta(none, "y", "score").first()["fbeta"] == 0.0
    with pytest.raises(ValueError):
        metrics.soft_fbeta(five, "y", "score", beta=-1)
    loss = metrics.weighted_log_loss(five, "y", "score", weight=2.0).first()["log_loss"]
    expected = np.mean([-(2 * np.log(s) if y else np.log(1 - s)) for s, y in FIVE])
    assert loss == pytest.approx(expected, abs=1e-5)


def test_areas_do_not_depend_on_the_number_of_ranges(many):
    _, df = many
    one = {(r["g"], r["score"]): (r["tp"], r["fp"]) for r in metrics.curve_counts(df, "y", "score", ["g"], parts=1).collect()}
    split = metrics.curve_counts(df, "y", "score", ["g"], parts=9).collect()
    assert {(r["g"], r["score"]): (r["tp"], r["fp"]) for r in split} == one
