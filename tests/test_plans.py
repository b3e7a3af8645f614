"""What the physical plans must and must not hold, and queries beside their SQL."""

from __future__ import annotations

import os
import re
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from riskframe.functions import stats, tokens
from riskframe.operators import lookup, vocab
from riskframe.plans import all_oracles, all_queries

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare import TABLES, compare  # noqa: E402


def plan_lines(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [(len(re.match(r"^[\s:+\-]*", line).group()), line.strip(" :+-")) for line in text.splitlines()]


def gathered_without_aggregation(df):
    """Single-partition exchanges whose input is not the result of an aggregate."""
    lines, found = plan_lines(df), []
    for i, (_, line) in enumerate(lines):
        if not line.startswith("Exchange SinglePartition"):
            continue
        below = next(
            (text for _, text in lines[i + 1 :] if not re.match(r"(\*\(\d+\) )?(Project|Filter|Sort|Window)", text)), ""
        )
        if "Aggregate" not in below and "TakeOrdered" not in below:
            found.append((line, below))
    return found


SCALABLE = (
    "split_text_profile train_val_test stratified_split random_folds stratified_folds shuffled_kfold "
    "text_stats clean_text vocab_topk bow_counts tfidf word_index text_to_ids value_counts distinct_counts "
    "describe_numeric metrics_binary roc_curve pr_curve auroc roc_grid roc_band embedding_pool"
).split()


@pytest.mark.parametrize("name", SCALABLE)
def test_no_task_gathers_unaggregated_rows(spark, small, name):
    assert gathered_without_aggregation(all_queries()[name](spark, small)) == []


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = all_queries()["semi_join_ids"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal,5000.0)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_text_work_is_narrow_and_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "a text")], "id long, x string")
    featured = stats.with_text_stats(df, ["x"]).withColumn("clean", tokens.clean_text(F.col("x")))
    plan = featured._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    terms = vocab.exploded_terms(df.withColumn("t", vocab.bow_tokens(F.col("x"))), "id", "t")
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_once_per_row(spark):
    df = spark.createDataFrame([(1, "a text")], "id long, x string")
    terms = vocab.exploded_terms(df.withColumn("t", vocab.bow_tokens(F.col("x"))), "id", "t")
    plan = terms._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("sort_array") == 1


def test_large_lookup_tables_are_not_broadcast_by_hint(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    table = spark.range(3).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    hinted = lookup.lookup_join(df, table, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    plain = lookup.lookup_join(df, table, ["k"], max_bytes=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in hinted and "strategy=broadcast" not in plain


def test_contract(spark):
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    result = contract.entry(spark)
    assert result.count() == 6 and {"part", "is_bad", "n"} <= set(result.columns)


COMPARED = (
    "split_text_profile csv_scan schema_by_dtype ground_truth fold_ground_truth feature_table fill_missing "
    "semi_join_ids anti_join_ids union_parts stratified_split random_folds stratified_folds map_with_default "
    "normalize_text clean_text text_stats pos_counts stem_map rewrite_tokens vocab_train_val bow_counts tfidf "
    "describe_numeric profile_report class_weights impute_scale metrics_binary roc_grid pr_curve auprc "
    "text_to_ids embedding_pool lexicon_score dict_vectorize"
).split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_sql(spark, small, duck, name):
    message, _, good = compare(spark, duck, small, name, all_queries()[name], all_oracles()[name])
    assert good, message
