from __future__ import annotations

import csv
import json
import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.functions import encode
from riskframe.operators import profile
from riskframe.session import shared_folder
from riskframe.sources import sinks, tables


def test_csv_follows_pandas(spark, tmp_path):
    path = tmp_path / "loans.csv"
    path.write_text(
        'Id,is_bad,emp_length,Notes,annual_inc,ok\n1,0,na,"two\nlines, ""quoted""",100.5,True\n'
        "2,1,10,N/A,,False\n3,0,NA,null,7,True\n"
    )
    df = tables.read_csv(spark, str(path))
    expected = pd.read_csv(path, keep_default_na=False, na_values=list(tables.NA_TOKENS))
    assert dict(df.dtypes) == {
        "Id": "bigint", "is_bad": "bigint", "emp_length": "string", "Notes": "string",
        "annual_inc": "double", "ok": "boolean",
    }
    rows = df.orderBy("Id").collect()
    assert [r["emp_length"] for r in rows] == ["na", "10", None]
    assert rows[0]["Notes"] == 'two\nlines, "quoted"' == expected["Notes"][0]
    assert rows[1]["Notes"] is None and rows[2]["Notes"] is None and rows[1]["annual_inc"] is None


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "train"), (2, 1, "val"), (3, 1, "train")], "Id long, y int, part string")
    sinks.write_ground_truth(df, str(tmp_path / "truth"), "Id", "y")
    lines = sorted(
        line for f in (tmp_path / "truth" / "part=train").glob("*.csv") for line in f.read_text().split()
    )
    assert lines == ["1,0", "3,1"]
    scores = df.withColumn("prediction", F.lit(0.1234567))
    sinks.write_predictions(scores, str(tmp_path / "scores"), "Id", "y")
    back = spark.read.csv(str(tmp_path / "scores"), header=True)
    assert back.columns == ["Id", "prediction", "y_true"]
    assert {r["prediction"] for r in back.collect()} == {"0.123457"}
    sinks.write_metrics(df.groupBy("part").agg(F.count("*").alias("n")), str(tmp_path / "metrics"))
    records = [json.loads(x) for f in Path(tmp_path / "metrics").glob("*.json") for x in f.read_text().splitlines()]
    assert {r["part"]: r["n"] for r in records} == {"train": 2.0, "val": 1.0}
    sinks.write_features(df, str(tmp_path / "features"))
    assert spark.read.parquet(str(tmp_path / "features")).count() == 3


def test_embedding_file(spark, tmp_path):
    path = tmp_path / "vectors.txt"
    path.write_text("pay 1.5 -2 3e-1\nloan 0 0 1\n")
    rows = {r["word"]: r["vector"] for r in tables.read_embeddings(spark, str(path)).collect()}
    assert rows["pay"] == pytest.approx([1.5, -2, 0.3]) and rows["loan"] == [0, 0, 1]


def test_recoding(spark):
    df = spark.createDataFrame([("PC1",), ("PC9",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(encode.policy_code(F.col("x"))).collect()] == [1, 6, 0, 0]
    df = spark.createDataFrame([("VERIFIED - income",), ("VERIFIED - income source",), ("not verified",), ("?",), (None,)], "x string")
    assert [r[0] for r in df.select(encode.verification_status(F.col("x"))).collect()] == [1, 1, 2, 3, 0]
    df = spark.createDataFrame([("NONE",), ("RENT",), ("?",), (None,)], "x string")
    assert [r[0] for r in df.select(encode.home_ownership(F.col("x"))).collect()] == [0, 3, 4, 4]


def test_profile_follows_pandas(spark):
    pdf = pd.DataFrame(
        {"c": ["a", "b", "a", None, "c", "a"], "v": [1.0, 5.0, None, 2.0, 2.0, 9.5], "w": [3.0] * 6}
    )
    df = spark.createDataFrame(
        [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)],
        "c string, v double, w double",
    )
    found = {(r["column"], r["stat"]): r["value"] for r in profile.profile(df, ["c"], ["v", "w"]).collect()}
    assert found[("c", "nulls")] == 1 and found[("v", "nulls")] == 1
    assert found[("c", "distinct")] == 3 and found[("c", "count:a")] == 3
    names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "25%": "q1", "50%": "q2", "75%": "q3", "max": "max"}
    for column in ("v", "w"):
        for theirs, ours in names.items():
            assert found[(column, ours)] == pytest.approx(pdf[column].describe()[theirs])
    ordered = profile.ascending(profile.value_counts(df, ["c"])).collect()
    assert [r["count"] for r in ordered] == [1, 1, 3]


def test_quantiles_across_many_buckets(spark):
    values = [float((i * 7919) % 100_003) for i in range(60_000)] + [5.0] * 30_000
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = profile.exact_quantiles(df, ["v"], (0.1, 0.5, 0.9)).first()
    expected = pd.Series(values).quantile([0.1, 0.5, 0.9])
    assert [row["q1"], row["q2"], row["q3"]] == pytest.approx(list(expected))


def test_quantiles_of_far_negative_and_missing_values(spark):
    inf, nan = float("inf"), float("nan")
    values = [-1e300, -2.5, -2.5, -0.0, 0.0, 1e-310, 3.0, 1e300, inf, -inf, 7.25]
    rows = [(v, None, float(i) if i % 2 else None) for i, v in enumerate(values)] + [(nan, nan, nan), (None, None, None)]
    df = spark.createDataFrame(rows, "v double, none double, w double").repartition(3)
    ordered = sorted(values)
    found = profile.select_ranks(df, ["v", "none", "w"], [range(len(values)), [], [0, 4]])
    assert [found[0][r] for r in range(len(values))] == ordered
    assert found[1] == {} and found[2] == {0: 1.0, 4: 9.0}
    quantiles = {r["column"]: r for r in profile.exact_quantiles(df, ["none", "w"], (0.5, 1.0)).collect()}
    assert set(quantiles) == {"w"} and (quantiles["w"]["q1"], quantiles["w"]["q2"]) == (5.0, 9.0)


def test_quantiles_shuffle_counts_not_rows(spark):
    many = spark.range(0, 200_000, 1, 4).select((F.col("id") % 1000).cast("double").alias("v"))
    rows = profile._digit_counts(many, ["v"], [[0]], 48)
    assert rows.count() < 200 and rows.agg(F.sum("n")).first()[0] == 200_000


def test_the_cluster_folder_is_used(spark):
    assert shared_folder(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())


def test_nan_counts_as_missing_in_profiles(spark):
    values = [1.0, float("nan"), None, 3.0, 10.0, 4.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    truth = pd.Series(values, dtype=float).describe()
    nulls = {r["column"]: r["nulls"] for r in profile.null_counts(df, ["id", "v"]).collect()}
    assert nulls == {"id": 0, "v": 2}
    row = profile.describe_numeric(df, ["v"]).first()
    names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "q1": "25%", "q2": "50%", "q3": "75%", "max": "max"}
    assert [row[n] for n in names] == pytest.approx([truth[t] for t in names.values()])
    rough = profile.describe_numeric(df, ["v"], approximate=True).first()
    assert rough["count"] == 4 and rough["min"] <= rough["q1"] <= rough["q2"] <= rough["q3"] <= rough["max"]


def test_csv_with_line_breaks_is_read_in_splits(spark, tmp_path):
    draw = random.Random(9)
    cells = ["", "a", "two words", "line\nbreak", 'quo"te', '"\n"', "comma, here", "\n\n", "é\n漢", "x" * 300 + "\n" + "y" * 300, "NA", "12"]
    path = tmp_path / "many.csv"
    rows = [[str(i), *(draw.choice(cells) for _ in range(3))] for i in range(400)]
    for name, part in (("a.csv", rows[:250]), ("b.csv", rows[250:])):
        path.mkdir(exist_ok=True)
        with open(path / name, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(["id", "a b", "c", "d.e"])
            out.writerows(part)
    whole = spark.read.options(**tables.QUOTES).option("multiLine", True).csv(str(path))
    want = sorted(tuple(None if c in tables.NA_TOKENS else c for c in r) for r in whole.collect())
    bytes_ = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("97", "1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            schema = tables.T.StructType([tables.T.StructField(n, tables.T.StringType()) for n in ("id", "a b", "c", "d.e")])
            found = sorted(tuple(r) for r in tables.read_csv(spark, str(path), schema).collect())
            assert [tuple(str(x) for x in r) for r in found] == [tuple(str(x) for x in r) for r in want]
            tasks = spark.read.text(str(path)).rdd.getNumPartitions()
            assert tasks > 100 if size == "97" else tasks >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_csv_of_a_header_alone_and_windows_line_ends(spark, tmp_path):
    path = tmp_path / "few.csv"
    path.write_bytes(b'"i\nd",b\r\n')
    assert tables.read_csv(spark, str(path)).columns == ["i\nd", "b"] and tables.read_csv(spark, str(path)).count() == 0
    path = tmp_path / "windows.csv"
    path.write_bytes(b'id,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n')
    assert sorted(map(tuple, tables.read_csv(spark, str(path)).collect())) == [(1, "x\ny"), (2, "z")]
