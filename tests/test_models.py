from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskframe.operators import classify, lookup, prep, splits, topics, vocab


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(5, 3, 400), rng.exponential(2, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(a - 6 + b)))).astype(int)
    a[::9] = np.nan
    rows = [(i, float(a[i]), float(b[i]), 7.0, None, int(y[i])) for i in range(400)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int")


def test_imputation_and_scaling(table):
    train = table.filter(F.col("id") < 300)
    imputer = prep.MeanImputer.fit(train, ["a", "b", "c", "d"])
    assert imputer.kept == ["a", "b", "c"]
    filled = imputer.transform(table)
    assert "d" not in filled.columns and filled.filter(F.isnan("a") | F.col("a").isNull()).count() == 0
    scaled = prep.Standardizer.fit(imputer.transform(train), imputer.kept).transform(filled)
    pdf = scaled.filter(F.col("id") < 300).toPandas()
    assert np.allclose(pdf[["a", "b"]].mean(), 0, atol=1e-9) and np.allclose(pdf[["a", "b"]].std(ddof=0), 1)
    assert (pdf["c"] == 0).all()
    bounded = prep.MinMaxScaler.fit(filled, ["b", "c"]).transform(filled).toPandas()
    assert bounded["b"].min() == 0 and bounded["b"].max() == 1 and (bounded["c"] == 0).all()


def newton(X, y, w, C):
    Z = np.hstack([X, np.ones((len(X), 1))])
    beta, penalty = np.zeros(Z.shape[1]), np.eye(Z.shape[1])
    penalty[-1, -1] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-Z @ beta))
        gradient = penalty @ beta + C * Z.T @ (w * (p - y))
        hessian = penalty + C * (Z * (w * p * (1 - p))[:, None]).T @ Z
        beta -= np.linalg.solve(hessian, gradient)
    return beta


@pytest.mark.parametrize("weights", [classify.FIXED_WEIGHTS, "balanced", None])
def test_logistic_regression_solves_the_stated_problem(table, weights):
    rows = prep.fit_features(table, ["a", "b"]).transform(table)
    model = classify.fit_logistic(rows, "y", C=0.1, weights=weights, tol=1e-12)
    pdf = rows.select("y", vector_to_array("features").alias("f")).toPandas()
    X, y = np.array(pdf["f"].tolist()), pdf["y"].to_numpy()
    counts = np.bincount(y)
    by_class = {
        "balanced": len(y) / (2 * counts), None: np.ones(2),
    }.get(weights if not isinstance(weights, dict) else "map", np.array([57.0, 386.0]))
    beta = newton(X, y, by_class[y], 0.1)
    assert np.allclose(model.coefficients.toArray(), beta[:-1], atol=1e-4)
    assert model.intercept == pytest.approx(beta[-1], abs=1e-4)
    scores = classify.scored(model, rows, ["id"]).toPandas()
    assert ((scores["score"] > 0.5).astype(int) == scores["prediction"]).all()


def test_sparse_block_is_scaled_by_population_deviation(spark):
    rows = [(i, Vectors.sparse(3, [0], [float(i % 2)])) for i in range(10)]
    df = spark.createDataFrame(rows, ["id", "v"])
    out = prep.unit_variance(df, "v", "s").transform(df).select(vector_to_array("s").alias("s")).toPandas()
    values = np.array(out["s"].tolist())
    assert np.std(values[:, 0]) == pytest.approx(1.0) and (values[:, 1:] == 0).all()


@pytest.mark.parametrize("leaky", [False, True])
def test_every_row_is_scored_by_a_model_that_has_not_seen_it(table, leaky):
    folds = splits.stratified_folds(table, "y", "id", folds=3)
    test = table.filter(F.col("id") % 10 == 0)
    oof, averaged = classify.cross_validate(
        folds, "y", ["id"], ["a", "b"], lambda d: classify.fit_logistic(d, "y"), folds=3, leaky=leaky, test=test
    )
    found = oof.toPandas()
    assert sorted(found["id"]) == list(range(400))
    assert averaged.count() == test.count()
    wide = classify.per_class(averaged, "id").toPandas()
    assert np.allclose(wide["class_0"] + wide["class_1"], 1)


def test_other_classifiers_learn(table):
    rows = prep.fit_features(table, ["a", "b"]).transform(table)
    truth = table.select("id", F.col("y").alias("truth"))
    svc = classify.fit_svc(rows, "y").transform(rows).join(truth, "id")
    assert svc.filter(F.col("prediction") == F.col("truth")).count() > 280
    net = classify.scored(classify.fit_perceptron(rows, "y", [2, 4, 2]), rows, ["id"]).join(truth, "id")
    assert net.filter(F.col("prediction") == F.col("truth")).count() > 280


def test_vector_sizes_leave_sparse_vectors_sparse(spark):
    wide = Vectors.sparse(2_000_000_000, [3, 7, 9], [1.0, 0.0, float("nan")])
    rows = [(0, wide), (1, Vectors.dense([0.0, 2.0, -0.0])), (2, Vectors.sparse(4, [], []))]
    df = spark.createDataFrame(rows, ["id", "v"])
    found = df.select("id", *prep.vector_sizes("v")).orderBy("id").collect()
    assert [tuple(r) for r in found] == [(0, 2_000_000_000, 2), (1, 3, 1), (2, 4, 0)]


def test_weighted_union(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0])], "a array<double>, b array<double>")
    df = df.select(array_to_vector("a").alias("a"), array_to_vector("b").alias("b"))
    for stage in prep.weighted_union({"a": 0.5, "b": 2.0}, {"a": 2, "b": 1}, "f"):
        df = stage.transform(df)
    assert df.first()["f"].toArray().tolist() == [0.5, 1.0, 6.0]


@pytest.fixture(scope="module")
def blocks(spark):
    """Rows from two disjoint sets of terms, as the long form of a term matrix."""
    rng = np.random.default_rng(0)
    X = np.zeros((60, 8))
    X[:30, :4] = rng.random((30, 4)) + 0.1
    X[30:, 4:] = rng.random((30, 4)) + 0.1
    cells = [(int(i), int(j), float(X[i, j])) for i, j in zip(*X.nonzero())]
    long = spark.createDataFrame(cells, "id long, term_id long, v double")
    return X, topics.term_rows(long, "id", "v")


@pytest.mark.parametrize("loss", ["frobenius", "kullback-leibler"])
def test_factorisation_finds_the_blocks(blocks, loss):
    _, rows = blocks
    H = topics.fit_nmf(rows, 8, 2, loss, alpha=0.0, max_iter=15)
    assert (H >= 0).all()
    share = H[:, :4].sum(axis=1) / H.sum(axis=1)
    assert sorted(np.round(share)) == [0, 1]


def test_svd_equals_numpy(spark, blocks):
    X, _ = blocks
    X = np.vstack([X, np.zeros(8)])
    vectors = []
    for i, x in enumerate(X):
        at = [int(j) for j in x.nonzero()[0]]
        vectors.append((i, Vectors.dense(x) if i % 2 else Vectors.sparse(8, at, x[at])))
    rows = spark.createDataFrame(vectors, ["id", "v"])
    V = topics.fit_svd(rows, "v", 3)
    expected = np.linalg.svd(X)[2][:3].T
    assert np.allclose(np.abs(V), np.abs(expected), atol=1e-6)
    found = topics.project(rows, "id", "v", V).orderBy("id").toPandas()
    assert np.allclose(np.array(found["projection"].tolist()), X @ V)


def test_svd_of_cells_equals_numpy(spark, blocks):
    X, _ = blocks
    X = np.vstack([X, np.zeros(8)])
    cells = [(int(i), f"t{j}", float(X[i, j])) for i, j in zip(*X.nonzero())]
    df = spark.createDataFrame(cells, "id long, term string, value double")
    found, V, size = topics.svd_of_cells(df, "id", 3)
    expected = np.linalg.svd(X)[2][:3].T
    vectors = {r.term: r.v for r in V.collect()}
    V = np.array([vectors[f"t{j}"] for j in range(8)])
    assert size == 3 and np.allclose(np.abs(V), np.abs(expected), atol=1e-6)
    for r in found.collect():
        assert np.allclose(r.projection, X[r.id] @ V)


def test_body_block_uses_all_terms(spark):
    # More than 1,000 terms: each document of rare words has its part in the decomposition.
    from riskframe.plans.extras import BODY_DIMENSIONS, body_block, bow_frame

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.terms for r in bow_frame(spark, folder).collect()}
    at = {t: j for j, t in enumerate(sorted(set().union(*texts.values())))}
    assert len(at) > 1000
    X = np.zeros((len(texts), len(at)))
    for i, terms in enumerate(texts.values()):
        for t in terms:
            X[i, at[t]] += 1
    X *= np.log((1 + len(X)) / (1 + (X > 0).sum(axis=0))) + 1
    X /= np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-300)
    found = body_block(spark, folder)[0].collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    got = np.linalg.norm([r.projection for r in found], axis=0)
    want = np.linalg.svd(X, compute_uv=False)[:BODY_DIMENSIONS]
    assert np.allclose(got[:20], want[:20], rtol=0.01) and np.allclose(got, want, rtol=0.05)


def test_tfidf_vectors_keep_every_row(spark):
    rows = [(0, ["a", "b", "a"]), (1, []), (2, ["z"]), (3, ["b", "b"]), (4, None)]
    df = spark.createDataFrame(rows, "id long, terms array<string>").fillna({})
    df = df.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    known = vocab.vocabulary(df, "terms").where("term != 'z'")
    found = {r.id: r.vector.toArray().tolist() for r in topics.tfidf_vectors(df, "id", "terms", known).collect()}
    weights = {(r.id, r.term_id): r.tfidf for r in vocab.tfidf(df, "id", "terms", known).collect()}
    assert sorted(found) == [0, 1, 2, 3, 4]
    for key, row in found.items():
        assert np.allclose(row, [weights.get((key, j), 0.0) for j in range(2)])


def test_sparse_products_of_arrow_rows():
    batch = pa.RecordBatch.from_pydict({"terms": [[1], [0, 2], []], "values": [[2.0], [1.0, 3.0], []]}).slice(1)
    x = topics._Sparse(batch)
    X, H, W = np.array([[1.0, 0, 3], [0, 0, 0]]), np.arange(6.0).reshape(2, 3), np.array([[1.0, 2], [3, 4]])
    assert np.array_equal(x.times(x.val, H), X @ H.T)
    assert np.array_equal(x.transposed_times(x.val, W, 3), W.T @ X)


def test_top_terms(spark, blocks):
    vocabulary = spark.createDataFrame([(i, f"t{i}") for i in range(3)], "term_id long, term string")
    H = np.array([[0.1, 0.9, 0.5], [3.0, 1.0, 2.0]])
    best = topics.top_terms(topics.nmf_topic_terms(vocabulary, H), vocabulary, 2)
    found = {(r["topic"], r["place"]): r["term"] for r in best.collect()}
    assert found == {(0, 1): "t1", (0, 2): "t2", (1, 1): "t0", (1, 2): "t2"}


def test_scoring_works_before_and_after_a_salted_lookup(spark, table):
    rows = prep.fit_features(table, ["a", "b"]).transform(table)
    before = classify.fit_logistic(rows, "y")
    df = spark.range(1000).select("id", F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("k"))
    names = spark.range(1000).toDF("k").withColumn("v", F.lit(1))
    assert lookup.lookup_join(df, names, ["k"], max_bytes=0).count() == 1000
    after = classify.fit_logistic(rows, "y")
    for model in (before, after):
        assert model.transform(rows).count() == 400


def test_svd_of_cells_moves_no_products(spark, blocks, monkeypatch):
    # F7, F8: every round joined and shuffled sixty numbers for every cell, twice.
    calls, plain = [], topics.lookup_join
    monkeypatch.setattr(topics, "lookup_join", lambda *given, **more: calls.append(1) or plain(*given, **more))
    monkeypatch.setattr(topics, "CHUNK", 7)
    monkeypatch.setattr(topics, "CELLS_PART", 20)
    X, _ = blocks
    cells = [(int(i), f"t{j}", float(X[i, j])) for i, j in zip(*X.nonzero())]
    # Repeated cells add up; cells of no key have a projection, and terms do not learn from them.
    cells += [cells[0], (None, "t1", 1.0), (None, "t2", 2.0)]
    X = X.copy()
    X[cells[0][0], int(cells[0][1][1:])] *= 2
    df = spark.createDataFrame(cells, "id long, term string, value double")
    found, V, size = topics.svd_of_cells(df, "id", 8)
    vectors = {r.term: r.v for r in V.collect()}
    V = np.array([vectors[f"t{j}"] for j in range(8)])
    assert len(calls) == 1 and size == 8 and np.allclose(V.T @ V, np.eye(8)) and (V.max(0) >= -V.min(0)).all()
    got = {r.id: r.projection for r in found.collect()}
    nobody = np.zeros(8)
    nobody[[1, 2]] = 1.0, 2.0
    assert sorted(k for k in got if k is not None) == sorted({c[0] for c in cells if c[0] is not None})
    for key, row in got.items():
        assert np.allclose(row, (nobody if key is None else X[key]) @ V)
