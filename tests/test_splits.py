from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskframe.operators import rank, splits


def people(spark, n, parts=4, bad=lambda i: int(i % 7 == 0)):
    return spark.createDataFrame([(i, bad(i)) for i in range(n)], "id long, y int").repartition(parts)


@pytest.mark.parametrize("n", [10, 100, 1003])
def test_parts_are_exact_complete_and_disjoint(spark, n):
    df = splits.train_val_test_split(people(spark, n), "y", "id")
    rows = df.collect()
    assert sorted(r["id"] for r in rows) == list(range(n))
    sizes = Counter(r["part"] for r in rows)
    train = n - math.ceil(0.3 * n)
    rest = n - train
    val = rest - math.ceil(0.3 * rest)
    assert sizes == {"train": train, "val": val, "test": rest - val}
    positives = sum(r["y"] for r in rows)
    in_train = sum(r["y"] for r in rows if r["part"] == "train")
    assert abs(in_train - positives * train / n) < 1


def test_ten_thousand_rows_give_the_usual_sizes(spark):
    df = splits.train_val_test_split(people(spark, 10_000), "y", "id")
    sizes = {r["part"]: r["count"] for r in df.groupBy("part").count().collect()}
    assert sizes == {"train": 7000, "val": 2100, "test": 900}


def test_splits_do_not_depend_on_partitioning(spark):
    for split in (
        lambda d: splits.stratified_split(d, "y", "id"),
        lambda d: splits.stratified_folds(d, "y", "id"),
        lambda d: splits.random_folds(d, "id"),
        lambda d: splits.shuffled_folds(d, "id"),
        lambda d: splits.approximate_split(d, "id"),
    ):
        one = split(people(spark, 500, 1))
        many = split(people(spark, 500, 13)).select(one.columns)
        assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_seeds_differ(spark):
    df = people(spark, 200)
    a = splits.stratified_split(df, "y", "id", seed=1)
    b = splits.stratified_split(df, "y", "id", seed=2)
    assert a.exceptAll(b).count() > 0


def test_random_folds_leave_the_remainder_out(spark):
    df = splits.random_folds(people(spark, 103), "id", folds=5)
    assert {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()} == {i: 20 for i in range(5)}


def test_stratified_folds_are_consecutive_blocks_per_class(spark):
    df = splits.stratified_folds(people(spark, 103), "y", "id", folds=5)
    for y in (0, 1):
        ids = sorted((r["id"], r["fold"]) for r in df.filter(F.col("y") == y).collect())
        folds = [f for _, f in ids]
        assert folds == sorted(folds)
        sizes = [folds.count(k) for k in range(5)]
        assert sizes == [len(ids) // 5 + (k < len(ids) % 5) for k in range(5)]
    train, test = splits.fold_sides(df, 2)
    assert train.count() + test.count() == 103
    assert train.join(test, "id").count() == 0


def test_approximate_split_is_near_its_share(spark):
    df = splits.approximate_split(people(spark, 5000), "id")
    held = df.filter(F.col("part") == "holdout").count()
    assert abs(held / 5000 - 0.3) < 0.03
    assert "Exchange" not in splits.approximate_split(
        spark.range(10), "id"
    )._jdf.queryExecution().toString()


def test_running_totals_equal_a_plain_window(spark):
    rows = [(i, "ab"[i % 3 == 0], float((i * 37) % 101), i % 5) for i in range(400)]
    rows += [(1000 + i, None, float(i % 11), 1) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, g string, v double, w int")
    bucketed = df.withColumn("_bucket", F.floor(F.col("v") / 10))
    found = rank.running_totals(
        bucketed, {"total": F.col("w")}, "_bucket", [F.col("v").desc(), F.col("id")], ["g"], descending=True
    ).collect()
    expected = {}
    for g in ("a", "b", None):
        seen = 0
        for r in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])):
            seen += r[3]
            expected[r[0]] = seen
    assert {r["id"]: r["total"] for r in found} == expected
    assert {r["g"]: r["total_all"] for r in found} == {
        g: sum(r[3] for r in rows if r[1] == g) for g in ("a", "b", None)
    }


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_range_totals_equal_a_plain_window(spark, parts):
    rows = [(i, "ab"[i % 3 == 0], float((i * 37) % 101), i % 5 or None, i / 7) for i in range(400)]
    rows += [(1000 + i, None, float(i % 11), 1, 0.5) for i in range(50)] + [(2000, "z", None, 3, 1.0)]
    df = spark.createDataFrame(rows, "id long, g string, v double, w int, x double").repartition(5)
    found = rank.range_totals(
        df, {"total": F.col("w"), "share": F.col("x")}, [F.col("v").desc(), F.col("id")], ["g"], parts
    ).collect()
    assert len(found) == len(rows)
    for g in ("a", "b", None, "z"):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-(r[2] if r[2] is not None else -1e9), r[0]))
        seen, share, of = 0, 0.0, {r["id"]: r for r in found if r["g"] == g}
        for r in own:
            seen, share = seen + (r[3] or 0), share + r[4]
            assert of[r[0]]["total"] == seen and of[r[0]]["share"] == pytest.approx(share)
        assert {r["total_all"] for r in of.values()} == {seen}
    assert rank.range_totals(df.limit(0), {"total": F.col("w")}, [F.col("id")]).count() == 0


def test_rows_of_one_hot_key_spread_and_rank_once_each(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.lit(1).alias("y"))
    ranked = rank.key_rank(df, "k", by=["y"], parts=6)
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 6001))
    hot = [r["rank"] for r in ranked.where("k = 'hot'").collect()]
    assert max(hot) - min(hot) == len(hot) - 1
    sizes = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 2000


def test_plan_does_not_grow_with_the_rows(spark):
    def plan(n):
        ranked = rank.key_rank(spark.range(n).select(F.col("id").cast("string").alias("k")), "k")
        return len(ranked._jdf.queryExecution().optimizedPlan().toString().split("\n"))

    assert plan(1_000) == plan(1_000_000)


def test_text_keys_rank_like_numbers(spark):
    df = spark.range(3000).select(F.format_string("Customer#%09d", F.col("id") * 7919 % 3000).alias("k"), (F.col("id") % 3).alias("y"))
    for parts in (1, 16):
        rows = rank.key_rank(df, "k", by=["y"], parts=parts).collect()
        for y in range(3):
            own = sorted(((r["k"], r["rank"]) for r in rows if r["y"] == y))
            assert [r for _, r in own] == list(range(1, len(own) + 1))
    folds = splits.stratified_folds(df, "y", "k")
    assert folds.count() == 3000 and folds.where("fold is null").count() == 0
