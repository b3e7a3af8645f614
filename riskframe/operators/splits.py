"""Deterministic splits and folds with exact sizes.

Rounding rules, the same ones the usual stratified splitters apply: a hold-out
share ``s`` of ``n`` rows takes ``ceil(s * n)`` rows; the remaining quota is
shared among the classes in proportion, rounded down, and what is left goes one
row each to the classes with the largest fractions, the lower label first among
equals. Within a class rows are drawn in the order of a seeded hash of the key,
so the result does not depend on partitioning. Keys are unique and not null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.operators.rank import hash_key, hash_rank, key_rank

DEFAULT_SEED = 28


def class_quotas(counts: DataFrame, label: str, size: str, share: float, quota: str) -> DataFrame:
    """Add to a table of class sizes how many rows of each class are kept.

    ``counts`` has one row per class. ``share`` is the hold-out share.
    """
    everything = Window.partitionBy()
    wide = "decimal(18,0)"
    by_fraction = everything.orderBy(F.desc("_modulus"), F.asc(label))
    return (
        counts.withColumn("_n", F.sum(size).over(everything))
        .withColumn("_kept", F.col("_n") - F.ceil(F.lit(float(share)) * F.col("_n")))
        .withColumn("_product", F.col("_kept").cast(wide) * F.col(size).cast(wide))
        .withColumn("_modulus", F.col("_product") % F.col("_n"))
        .withColumn("_floor", ((F.col("_product") - F.col("_modulus")) / F.col("_n")).cast("long"))
        .withColumn("_left", F.col("_kept") - F.sum("_floor").over(everything))
        .withColumn(
            quota,
            F.col("_floor") + (F.row_number().over(by_fraction) <= F.col("_left")).cast("long"),
        )
        .drop("_n", "_kept", "_product", "_floor", "_modulus", "_left")
    )


def stratified_split(
    df: DataFrame, label: str, key: str, holdout: float = 0.3, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Add ``part`` = ``train`` or ``holdout``, with exact class quotas."""

    def quotas(sizes: DataFrame) -> DataFrame:
        return class_quotas(sizes, label, "rank", holdout, "_quota")

    part = F.when(F.col("rank") <= F.col("_quota"), "train").otherwise("holdout")
    return (
        hash_rank(df, key, seed, by=[label], attach=quotas)
        .withColumn("part", part)
        .drop("rank", "rank_all", "_quota")
    )


def train_val_test_split(
    df: DataFrame, label: str, key: str, holdout: float = 0.3, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Add ``part`` = ``train``, ``val`` or ``test``: the hold-out is split again.

    With the default share the parts hold 70, 21 and 9 per cent.
    """

    def quotas(sizes: DataFrame) -> DataFrame:
        first = class_quotas(sizes, label, "rank", holdout, "_train")
        rest = first.withColumn("_rest", F.col("rank") - F.col("_train"))
        return class_quotas(rest, label, "_rest", holdout, "_val").drop("_rest")

    part = (
        F.when(F.col("rank") <= F.col("_train"), "train")
        .when(F.col("rank") <= F.col("_train") + F.col("_val"), "val")
        .otherwise("test")
    )
    return (
        hash_rank(df, key, seed, by=[label], attach=quotas)
        .withColumn("part", part)
        .drop("rank", "rank_all", "_train", "_val")
    )


def approximate_split(
    df: DataFrame, key: str, holdout: float = 0.3, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Add ``part`` by a threshold on the hash: no shuffle, sizes only near the shares."""
    draw = F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("double") / 2**32
    return df.withColumn("part", F.when(draw >= holdout, "train").otherwise("holdout"))


def _block(rank: Column, size: Column, folds: int) -> Column:
    # Consecutive blocks as even as possible, the longer ones first.
    short = F.floor(size / folds)
    extra = size % folds
    long_rows = extra * (short + 1)
    zero_based = rank - 1
    return F.when(
        zero_based < long_rows, F.floor(zero_based / (short + 1))
    ).otherwise(
        extra + F.floor((zero_based - long_rows) / F.greatest(short, F.lit(1)))
    ).cast("int")


def random_folds(df: DataFrame, key: str, folds: int = 5, seed: int = DEFAULT_SEED) -> DataFrame:
    """Add ``fold`` 0..folds-1, all of size ``int(n / folds)``; the remainder is left out."""
    size = F.floor(F.col("rank_all") / folds)
    return (
        hash_rank(df, key, seed)
        .filter(F.col("rank") <= size * folds)
        .withColumn("fold", F.floor((F.col("rank") - 1) / size).cast("int"))
        .drop("rank", "rank_all")
    )


def shuffled_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 239) -> DataFrame:
    """Add ``fold`` 0..folds-1 in shuffled order; every row belongs to a fold."""
    return (
        hash_rank(df, key, seed)
        .withColumn("fold", _block(F.col("rank"), F.col("rank_all"), folds))
        .drop("rank", "rank_all")
    )


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5) -> DataFrame:
    """Add ``fold`` 0..folds-1: per class, consecutive blocks in key order."""
    return (
        key_rank(df, key, by=[label])
        .withColumn("fold", _block(F.col("rank"), F.col("rank_all"), folds))
        .drop("rank", "rank_all")
    )


def fold_sides(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """The (train, test) frames of one fold."""
    return df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold)


def fold_side_counts(df: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """Rows of the train and the test side of every fold, from one count per fold."""
    sizes = df.groupBy("fold").agg(F.count("*").alias("test_rows"), *extra)
    total = F.sum("test_rows").over(Window.partitionBy())
    return sizes.withColumn("train_rows", total - F.col("test_rows"))
