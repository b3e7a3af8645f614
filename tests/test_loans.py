"""The whole run on a small loan table."""

from __future__ import annotations

import csv
import random

from pyspark.sql import functions as F

from riskframe import loans


def write_table(path, n=400):
    rng = random.Random(11)
    columns = ["Id", "is_bad", *loans.TEXTS, *loans.CATEGORIES, *loans.NUMBERS]
    words = "loan card debt pay bills home business wedding car medical consolidate rate".split()
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(columns)
        for i in range(n):
            bad = int(rng.random() < 0.2)
            notes = " ".join(rng.choice(words) for _ in range(8)) + (" late overdue" if bad else "")
            row = {
                "Id": i, "is_bad": bad, "emp_title": rng.choice(["NOVA", "", "Clayton Eye Center"]),
                "Notes": f"  Borrower added on 0{i % 9 + 1}/14/11 >\n{notes}!<br/>" if i % 5 else "",
                "purpose": rng.choice(["Mike's loan", "Pay off"]), "emp_length": rng.choice(["na", "10"]),
                "home_ownership": rng.choice(["RENT", "OWN", "BOAT"]), "verification_status": "not verified",
                "policy_code": f"PC{i % 6}", "pymnt_plan": "n", "initial_list_status": "f",
                "addr_state": "NY", "purpose_cat": "car",
            }
            row.update({c: "" if rng.random() < 0.1 else round(rng.gauss(10 + 5 * bad, 3), 2) for c in loans.NUMBERS})
            row["mths_since_last_major_derog"] = ""
            out.writerow([row[c] for c in columns])


def test_the_whole_run(spark, tmp_path):
    path = str(tmp_path / "loans.csv")
    write_table(path)
    assert len(loans.MODEL_COLUMNS) == 51 and len(set(loans.MODEL_COLUMNS)) == 51
    result = loans.run(spark, path, str(tmp_path / "out"), folds=3)

    sizes = {r["part"]: r["count"] for r in result.scores.groupBy("part").count().collect()}
    assert sizes == {"train": 280, "val": 84, "test": 36}
    judged = {r["part"]: r for r in result.metrics.collect()}
    assert set(judged) == {"train", "val", "test"}
    assert judged["train"]["auroc"] > 0.95 and judged["val"]["auroc"] > 0.8
    assert all(r["auroc"] > 0.7 for r in result.fold_areas.collect()) and result.fold_areas.count() == 3
    assert result.roc_band.count() == 100 and result.weights.count() == 2

    report = {(r["column"], r["stat"]): r["value"] for r in result.profile.collect()}
    assert report[("emp_length", "count:na")] + report[("emp_length", "count:10")] == 280
    assert report[("mths_since_last_major_derog", "nulls")] == 280

    features = spark.read.parquet(str(tmp_path / "out" / "features"))
    empty = features.filter(F.col("Id") == 0).first()
    assert empty["clean_text"] == "" and empty["count_word_raw_Notes"] == 1
    assert {r[0] for r in features.select("home_ownership").distinct().collect()} == {1, 3, 4}
    written = spark.read.csv(str(tmp_path / "out" / "predictions"), header=True)
    assert written.count() == 400 and written.columns == ["Id", "prediction", "y_true"]
