"""Class weights and binary classifiers on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.operators.prep import fit_features
from riskframe.session import checkpointed

# Fixed weights of the two classes in the final model.
FIXED_WEIGHTS = {0: 57.0, 1: 386.0}


def class_percent(df: DataFrame, label: str) -> DataFrame:
    """``(percent)``: share of the positive class, in per cent with two decimals."""
    return df.agg(F.round(100 * F.sum(label) / F.count("*"), 2).alias("percent"))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, weight)``: n / (classes * rows of the class)."""
    everything = Window.partitionBy()
    counts = df.groupBy(label).agg(F.count("*").alias("_rows"))
    weight = F.sum("_rows").over(everything) / (F.count("*").over(everything) * F.col("_rows"))
    return counts.select(label, weight.alias("weight"))


def weight_column(label: str, weights: Mapping[int, float]) -> Column:
    """The weight of a row by its label."""
    out: Column | None = None
    for value, weight in weights.items():
        condition, number = F.col(label) == value, F.lit(float(weight))
        out = F.when(condition, number) if out is None else out.when(condition, number)
    return out


def with_class_weights(
    df: DataFrame, label: str, weights: Mapping[int, float] | str | None, train: DataFrame | None = None
) -> DataFrame:
    """Add ``weight``: from a map, ``"balanced"`` on the training rows, or 1."""
    if weights is None:
        return df.withColumn("weight", F.lit(1.0))
    if weights == "balanced":
        # Two rows: the label is binary.
        rows = balanced_weights(df if train is None else train, label).collect()
        weights = {r[label]: r["weight"] for r in rows}
    return df.withColumn("weight", weight_column(label, weights))


def fit_logistic(
    train: DataFrame,
    label: str,
    features: str = "features",
    C: float = 0.1,
    weights: Mapping[int, float] | str | None = FIXED_WEIGHTS,
    max_iter: int = 100,
    tol: float = 1e-6,
) -> Model:
    """L2 logistic regression minimising ``|b|^2 / 2 + C * sum(weight * loss)``.

    The intercept is free. Spark's objective is the mean loss plus
    ``regParam * |b|^2 / 2``, hence ``regParam = 1 / (C * sum of weights)``.
    """
    weighted = with_class_weights(train, label, weights)
    total = weighted.agg(F.sum("weight").alias("w")).first()["w"]
    return LogisticRegression(
        labelCol=label,
        featuresCol=features,
        weightCol="weight",
        regParam=1.0 / (C * total),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
    ).fit(weighted)


def fit_svc(
    train: DataFrame, label: str, features: str = "features", C: float = 1.0, max_iter: int = 100
) -> Model:
    """Linear support-vector classifier with an L2 penalty."""
    n = train.count()
    return LinearSVC(
        labelCol=label, featuresCol=features, regParam=1.0 / (C * n), standardization=False, maxIter=max_iter
    ).fit(train)


def fit_perceptron(
    train: DataFrame,
    label: str,
    layers: Sequence[int],
    features: str = "features",
    seed: int = 42,
    max_iter: int = 50,
) -> Model:
    """Feed-forward network; ``layers`` runs from the number of inputs to that of classes."""
    return MultilayerPerceptronClassifier(
        labelCol=label, featuresCol=features, layers=list(layers), seed=seed, maxIter=max_iter
    ).fit(train)


def scored(model: Model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``(keep, score, prediction)``: probability of class 1 and the class at 0.5."""
    out = model.transform(df)
    return out.select(
        *keep,
        F.get(vector_to_array("probability"), F.lit(1)).alias("score"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def coefficients(model: Model, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(feature, coefficient)`` with the intercept, as a DataFrame."""
    rows = [(n, float(v)) for n, v in zip(names, model.coefficients.toArray())]
    rows.append(("(intercept)", float(model.intercept)))
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


Fit = Callable[[DataFrame], Model]


def cross_validate(
    df: DataFrame,
    label: str,
    keep: Sequence[str],
    numeric: Sequence[str],
    fit: Fit,
    bag: str | None = None,
    folds: int = 5,
    leaky: bool = False,
    test: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Out-of-fold scores of ``df`` (column ``fold``), and fold-averaged scores of ``test``.

    Imputation and scaling are fitted again on the training side of each fold;
    ``leaky=True`` fits them once on all rows. Every row of ``df`` is scored by the
    one model that has not seen it.
    """
    prepared = None
    if leaky:
        model = fit_features(df, numeric, bag)
        prepared = checkpointed(
            model.transform(df).select(*dict.fromkeys([*keep, label, "fold", "features"]))
        )
        prepared_test = None if test is None else model.transform(test)
    parts, test_parts = [], []
    for fold in range(folds):
        if leaky:
            rows, test_rows = prepared, prepared_test
        else:
            features = fit_features(df.filter(F.col("fold") != fold), numeric, bag)
            rows = features.transform(df)
            test_rows = None if test is None else features.transform(test)
        fitted = fit(rows.filter(F.col("fold") != fold))
        held = rows.filter(F.col("fold") == fold)
        parts.append(scored(fitted, held, list(dict.fromkeys([*keep, "fold", label]))))
        if test_rows is not None:
            test_parts.append(scored(fitted, test_rows, [*keep, label]))
    out_of_fold = reduce(DataFrame.unionByName, parts)
    if not test_parts:
        return out_of_fold, None
    every = reduce(DataFrame.unionByName, test_parts)
    averaged = every.groupBy(*dict.fromkeys([*keep, label])).agg(F.avg("score").alias("score"))
    return out_of_fold, averaged


def per_class(scores: DataFrame, key: str) -> DataFrame:
    """``(key, class_0, class_1)`` from the score of class 1."""
    return scores.select(key, (1 - F.col("score")).alias("class_0"), F.col("score").alias("class_1"))
