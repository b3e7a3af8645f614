"""Writers. Each is one distributed write; parts and folds become folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.operators.profile import schema_by_type


def write_schema(df: DataFrame, path: str) -> None:
    """The column names of every type, as JSON."""
    schema_by_type(df).write.mode("error").json(path)


def write_ground_truth(df: DataFrame, path: str, key: str, label: str, by: str = "part") -> None:
    """Headerless ``key,label`` files, one folder per value of ``by``."""
    df.select(key, label, by).write.mode("error").partitionBy(by).csv(path, header=False)


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A featurised table, as Parquet or headered CSV."""
    if fmt == "csv":
        df.write.mode("error").csv(path, header=True, escape='"')
    else:
        df.write.mode("error").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics records as JSON, all numbers as doubles."""
    numbers = {n: F.col(n).cast("double") for n, t in metrics.dtypes if t not in ("string", "boolean")}
    metrics.withColumns(numbers).write.mode("error").json(path)


def write_predictions(
    scores: DataFrame, path: str, key: str, truth: str, prediction: str = "prediction"
) -> None:
    """Headered CSV ``key,prediction,y_true`` with six decimals."""
    scores.select(
        key, F.format_string("%.6f", F.col(prediction).cast("double")).alias("prediction"),
        F.col(truth).alias("y_true"),
    ).write.mode("error").csv(path, header=True)
