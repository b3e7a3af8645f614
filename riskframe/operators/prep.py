"""Imputation, scaling and assembly of feature columns.

Fitting is one aggregate over the training rows; what comes back to the driver is a
handful of numbers per column. Applying is a projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import sqrt

from pyspark.ml import Transformer
from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import unwrap_udt


def as_number(name: str) -> Column:
    """The column as a double, with NaN as null."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def _fit(train: DataFrame, columns: Sequence[str], **aggregates) -> dict[str, dict[str, float]]:
    row = train.agg(
        *[f(as_number(c)).alias(f"{c}|{n}") for c in columns for n, f in aggregates.items()]
    ).first()
    return {c: {n: row[f"{c}|{n}"] for n in aggregates} for c in columns}


@dataclass(frozen=True)
class MeanImputer:
    """Fills missing values with the training mean.

    Columns without any value in training have no mean; they are dropped.
    """

    means: dict[str, float | None]

    @staticmethod
    def fit(train: DataFrame, columns: Sequence[str]) -> MeanImputer:
        return MeanImputer({c: v["mean"] for c, v in _fit(train, columns, mean=F.avg).items()})

    @property
    def kept(self) -> list[str]:
        return [c for c, mean in self.means.items() if mean is not None]

    def transform(self, df: DataFrame) -> DataFrame:
        filled = {c: F.coalesce(as_number(c), F.lit(self.means[c])) for c in self.kept}
        return df.withColumns(filled).drop(*[c for c in self.means if c not in filled])


@dataclass(frozen=True)
class Standardizer:
    """Zero mean and unit population variance; a constant column becomes 0."""

    moments: dict[str, dict[str, float]]

    @staticmethod
    def fit(train: DataFrame, columns: Sequence[str]) -> Standardizer:
        return Standardizer(_fit(train, columns, mean=F.avg, std=F.stddev_pop))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: (as_number(c) - F.lit(m["mean"])) / F.lit(m["std"] or 1.0)
                for c, m in self.moments.items()
            }
        )


@dataclass(frozen=True)
class MinMaxScaler:
    """Training minimum to 0, maximum to 1; a constant column becomes 0."""

    bounds: dict[str, dict[str, float]]

    @staticmethod
    def fit(train: DataFrame, columns: Sequence[str]) -> MinMaxScaler:
        return MinMaxScaler(_fit(train, columns, low=F.min, high=F.max))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: (as_number(c) - F.lit(b["low"])) / F.lit((b["high"] - b["low"]) or 1.0)
                for c, b in self.bounds.items()
            }
        )


def unit_variance(train: DataFrame, vector: str, output: str) -> ElementwiseProduct:
    """A stage that divides a sparse vector column by its population deviations.

    The mean is not taken away, which would make the vector dense. A model with a
    free intercept fits the same coefficients either way. Constant entries stay.
    """
    row = train.agg(
        Summarizer.metrics("variance", "count").summary(F.col(vector)).alias("s")
    ).first()["s"]
    n = row["count"]
    shrink = (n - 1) / n if n > 1 else 1.0
    factors = [1.0 / sqrt(v * shrink) if v > 0 else 1.0 for v in row["variance"].toArray()]
    return ElementwiseProduct(
        scalingVec=Vectors.dense(factors), inputCol=vector, outputCol=output
    )


@dataclass(frozen=True)
class FeatureModel:
    """Everything fitted on the training rows that turns a row into ``features``."""

    imputer: MeanImputer
    scaler: Standardizer
    bag: ElementwiseProduct | None
    assembler: VectorAssembler

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.scaler.transform(self.imputer.transform(df))
        if self.bag is not None:
            out = self.bag.transform(out)
        return self.assembler.transform(out)


def fit_features(
    train: DataFrame, numeric: Sequence[str], bag: str | None = None, output: str = "features"
) -> FeatureModel:
    """Fit imputation and scaling of ``numeric`` and of the sparse vector column ``bag``."""
    imputer = MeanImputer.fit(train, numeric)
    scaler = Standardizer.fit(imputer.transform(train), imputer.kept)
    stage = unit_variance(train, bag, f"_{bag}_scaled") if bag else None
    inputs = [*imputer.kept, *([f"_{bag}_scaled"] if bag else [])]
    return FeatureModel(
        imputer, scaler, stage, VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="error")
    )


def vector_sizes(vector: str) -> list[Column]:
    """``n_features`` and ``n_nonzero`` of a vector column; sparse vectors stay sparse."""
    parts = unwrap_udt(F.col(vector))
    values = parts["values"]
    return [
        F.coalesce(parts["size"], F.size(values)).alias("n_features"),
        F.size(F.filter(values, lambda v: v != 0)).alias("n_nonzero"),
    ]


def weighted_union(blocks: dict[str, float], sizes: dict[str, int], output: str) -> list[Transformer]:
    """Stages that join vector columns, each multiplied by its weight."""
    assembler = VectorAssembler(inputCols=list(blocks), outputCol=f"_{output}_plain")
    weights = [w for name, w in blocks.items() for _ in range(sizes[name])]
    product = ElementwiseProduct(
        scalingVec=Vectors.dense(weights), inputCol=f"_{output}_plain", outputCol=output
    )
    return [assembler, product]
