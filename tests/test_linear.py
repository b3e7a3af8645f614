"""The Newton solver against dense solves, and the folds against single fits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from riskframe.operators import linear

ROWS, TERMS = 300, 12


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    numbers = np.column_stack([rng.normal(50, 9, ROWS), rng.exponential(2, ROWS), np.full(ROWS, 3.0), np.full(ROWS, np.nan)])
    numbers[::7, 0] = np.nan
    bag = (rng.random((ROWS, TERMS)) < 0.2) * 1.0
    bag[:, 5] = 0.0
    chance = 1 / (1 + np.exp(-(numbers[:, 1] - 2 + bag[:, 0] * 2 - bag[:, 1])))
    return numbers, bag, (rng.random(ROWS) < chance).astype(int), np.arange(ROWS) % 4


@pytest.fixture(scope="module")
def rows(spark, data):
    numbers, bag, y, fold = data
    table = []
    for i in range(ROWS):
        at = np.flatnonzero(bag[i])
        vector = Vectors.sparse(TERMS, at.tolist(), bag[i, at].tolist()) if i % 3 else Vectors.dense(bag[i].tolist())
        a = None if np.isnan(numbers[i, 0]) else float(numbers[i, 0])
        table.append((i, a, float(numbers[i, 1]), 3.0, float("nan"), vector, int(y[i]), int(fold[i])))
    df = spark.createDataFrame(table, ["id", "a", "b", "c", "d", "bag", "y", "fold"])
    return linear.raw_rows(df.repartition(3), "y", ["a", "b", "c", "d"], "bag", "fold", ["id"])


WIDTH = 4 + TERMS


def scaled(numbers, bag, own):
    """Imputed and scaled columns by the rows ``own``; the same as the mean imputer and the scaler."""
    X = np.hstack([numbers, bag])
    there = ~np.isnan(X[own])
    mean = np.where(there.any(0), np.nansum(X[own], 0) / np.maximum(there.sum(0), 1), np.nan)
    X = np.where(np.isnan(X), mean, X)
    std = X[own].std(0)
    return np.nan_to_num((X - X[own].mean(0)) / np.where(std > 1e-9, std, 1.0))


def dense_newton(X, y, c, penalised, loss):
    Z = np.hstack([X, np.ones((len(X), 1))])
    beta, penalty = np.zeros(Z.shape[1]), np.diag([*np.ones(X.shape[1]), float(penalised)])
    sign = 2 * y - 1
    for _ in range(100):
        z = Z @ beta
        if loss == "logistic":
            p = 1 / (1 + np.exp(-z))
            r, h = p - y, p * (1 - p)
        else:
            r, h = np.where(sign * z < 1, 2 * (z - sign), 0), np.where(sign * z < 1, 2.0, 0)
        beta = beta - np.linalg.solve(penalty + (Z * (c * h)[:, None]).T @ Z, penalty @ beta + Z.T @ (c * r))
    return beta


@pytest.mark.parametrize("loss", linear.LOSSES)
@pytest.mark.parametrize("penalised", [True, False])
@pytest.mark.parametrize("whole_up_to", [0, 1000])
def test_folds_in_one_pass_agree_with_dense_solves(rows, data, loss, penalised, whole_up_to):
    numbers, bag, y, fold = data
    models = linear.fit_folds(
        rows, WIDTH, 4, C=0.1, weights={0: 2.0, 1: 5.0}, loss=loss, penalise_intercept=penalised, whole_up_to=whole_up_to
    )
    found = {r["id"]: list(r["margins"]) for r in linear.margins(rows, models, ["id"]).collect()}
    for k in range(4):
        own = fold != k
        X = scaled(numbers, bag, own)
        beta = dense_newton(X[own], y[own], 0.1 * np.where(y[own] == 1, 5.0, 2.0), penalised, loss)
        assert np.allclose(models.weights[k], beta[:-1], atol=1e-6)
        assert models.intercepts[k] == pytest.approx(beta[-1], abs=1e-6)
        margins = X @ beta[:-1] + beta[-1]
        assert np.allclose([found[i][k] for i in range(ROWS)], margins, atol=1e-5)
    # One scan a product, whatever the number of folds.
    assert models.scans < 150


def test_folds_equal_single_fits_and_leaky_scaling(rows, data):
    numbers, bag, y, fold = data
    models = linear.fit_folds(rows, WIDTH, 4, weights="balanced")
    for k in range(4):
        part = rows.where(f"_fold != {k}").drop("_fold").selectExpr("*", "-1 AS _fold")
        single = linear.fit_linear(part, linear.fit_scaling(part, WIDTH), weights="balanced")
        assert np.allclose(models.weights[k], single.weights[0], atol=1e-6)
    leaky = linear.fit_folds(rows, WIDTH, 4, leaky=True)
    X = scaled(numbers, bag, np.ones(ROWS, bool))
    own = fold != 2
    assert np.allclose(leaky.weights[2], dense_newton(X[own], y[own], np.ones(own.sum()), True, "logistic")[:-1], atol=1e-6)
    oof = {r["id"]: r for r in linear.out_of_fold(rows, leaky, ["id"], "y").collect()}
    every = {r["id"]: r["margins"] for r in linear.margins(rows, leaky, ["id"]).collect()}
    for i, r in oof.items():
        assert r["fold"] == fold[i] and r["score"] == pytest.approx(1 / (1 + np.exp(-every[i][fold[i]])))
        assert r["prediction"] == (every[i][fold[i]] > 0)
    mean = {r["id"]: r["score"] for r in linear.averaged(rows, leaky, ["id"], "y").collect()}
    assert mean[5] == pytest.approx(np.mean([1 / (1 + np.exp(-m)) for m in every[5]]))


def test_partial_sums_meet_in_a_tree(rows, monkeypatch):
    plain = linear.fit_scaling(rows, WIDTH, 4)
    monkeypatch.setattr(linear, "FAN_IN", 1)
    again = linear.fit_scaling(rows, WIDTH, 4)
    assert np.allclose(plain.mean, again.mean) and np.allclose(plain.inverse, again.inverse)


def test_rows_without_label_empty_tables_and_far_values(spark):
    df = spark.createDataFrame([(1, 1e9, 1), (2, 1e9 + 1, 0), (3, 1e9 + 2, 1), (4, 0.0, None), (5, 5.0, 7)], "id int, a double, y int")
    rows = linear.raw_rows(df, "y", ["a"], keep=["id"])
    scaling = linear.fit_scaling(rows, 1)
    assert scaling.mean[0, 0] == pytest.approx(1e9 + 1) and 1 / scaling.inverse[0, 0] == pytest.approx(np.sqrt(2 / 3))
    model = linear.fit_linear(rows, scaling)
    assert linear.margins(rows, model, ["id"]).count() == 5
    empty = linear.raw_rows(df.limit(0), "y", ["a"], keep=["id"])
    model = linear.fit_linear(empty, linear.fit_scaling(empty, 1))
    assert model.weights.tolist() == [[0.0]] and linear.score(empty, model, ["id"], "y").count() == 0


def test_packed_rows_give_the_same_model(spark):
    draw = np.random.default_rng(8)
    rows = [(None if i % 9 == 0 else int(i % 3 == 0), i % 4, float(draw.normal()), None if i % 5 == 0 else 1.0) for i in range(90)]
    df = spark.createDataFrame(rows, "y int, fold int, a double, b double").repartition(5)
    raw = linear.raw_rows(df, "y", ["a", "b"], fold="fold")
    blocks = linear.packed(raw)
    assert linear.packed(blocks) is blocks and blocks.rdd.getNumPartitions() == 1
    one, other = (linear.fit_folds(x, 2, 4, weights="balanced", penalise_intercept=False) for x in (raw, blocks))
    assert np.allclose(one.weights, other.weights) and np.allclose(one.intercepts, other.intercepts)
    counts = [sum(r[0] == label and r[1] != 2 for r in rows) for label in (0, 1)]
    assert np.allclose(linear.class_weights(blocks, "balanced", 4)[2], [sum(counts) / (2 * c) for c in counts])


def test_scans_of_a_fit_plan_no_query(rows, data, monkeypatch):
    # every scan was a query of its own.
    calls, plain = [], linear.tree_sum
    monkeypatch.setattr(linear, "tree_sum", lambda *given: calls.append(1) or plain(*given))
    monkeypatch.setattr(linear, "FAN_IN", 1)
    monkeypatch.setattr(linear, "LEAST_ENTRIES", 1)
    blocks = linear.packed(rows)
    assert blocks.rdd.getNumPartitions() > 1
    scaling = linear.fit_scaling(blocks, WIDTH)
    calls.clear()
    model = linear.fit_linear(blocks, scaling, weights="balanced", whole_up_to=0)
    # Class weights alone are counted by a query; scans of more than FAN_IN tasks meet in a tree.
    assert model.scans > 10 and len(calls) == 1


def test_blocks_are_small(rows, monkeypatch):
    # A batch of long rows was one block, which one task had to take.
    monkeypatch.setattr(linear, "BLOCK_ENTRIES", 100)
    blocks = linear.packed(rows)
    sizes = [r["_size"] for r in blocks.select("_size").collect()]
    assert max(sizes) <= 100 and sum(sizes) == linear.packed(rows).agg({"_size": "sum"}).first()[0]
    assert sum(len(r["_y"]) // 8 for r in blocks.collect()) == ROWS


def test_steps_of_the_hinge_are_lowest_points():
    # a Newton step across many bends was halved until the loss fell, not taken to the lowest point.
    bends = np.array([0.1, 0.2, 0.33, 1.7])
    tops = np.array([[0.15], [0.9], [3.0]])

    def slopes(at):
        return np.maximum(at[..., None] - bends, 0).sum(-1) - np.maximum(tops - bends, 0).sum(-1)[:, None]

    assert np.allclose(linear._lowest(slopes, 3), [0.15, 0.9, 2.0], atol=1e-4)
    assert np.allclose(linear._lowest(lambda at: at - at + 1.0, 1), 0.0)
