"""Sources, projection, joins, splits, recoding and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import encode, stats
from riskframe.operators import classify, profile, splits
from riskframe.plans.registry import query
from riskframe.plans.tables import (
    SQL_DOCS,
    SQL_FOLDS,
    SQL_GAPS,
    SQL_PARTS,
    SQL_TARGETS,
    documents,
    labelled,
    sql_quotas,
    table,
    targets,
    with_gaps,
)
from riskframe.plans.texts import rounded, sql_stat_columns
from riskframe.session import scratch_path
from riskframe.sources import sinks, tables as readers

# --- The flagship -----------------------------------------------------------------

STAT_COLUMNS = [f.format("text") for f in stats.FEATURE_NAMES.values()]


@query(
    "split_text_profile",
    f"""
    WITH {SQL_PARTS}, s AS (SELECT doc_id, {sql_stat_columns('text')} FROM documents)
    SELECT part, is_bad, count(*) AS n, {', '.join(f"round(avg({c}), 4) AS {c}" for c in STAT_COLUMNS)}
    FROM parts JOIN s USING (doc_id) GROUP BY part, is_bad
    """,
)
def _(spark, folder):
    # The split works on two narrow columns and the statistics are narrow, so only
    # numbers are shuffled, never texts.
    parts = splits.train_val_test_split(targets(spark, folder), "is_bad", "doc_id")
    counted = rounded(stats.with_text_stats(documents(spark, folder).select("doc_id", "text"), ["text"]).drop("text"))
    return parts.join(counted, "doc_id").groupBy("part", "is_bad").agg(
        F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in STAT_COLUMNS]
    )


# --- Sources and sinks --------------------------------------------------------------


@query("csv_scan", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def _(spark, folder):
    customer = table(spark, folder, "customer")
    path = scratch_path(spark, "customer-csv")
    # "N/A" is one of the texts that read as missing.
    gaps = F.when(F.col("c_mktsegment") == "BUILDING", "N/A").otherwise(F.col("c_mktsegment"))
    sinks.write_features(customer.withColumn("c_mktsegment", gaps), path, "csv")
    return readers.read_csv(spark, path)


@query(
    "schema_by_dtype",
    """
    SELECT dtype, string_agg(name, ',' ORDER BY name) AS columns FROM (
      SELECT column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string'
        WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END AS dtype
      FROM information_schema.columns WHERE table_name = 'orders')
    GROUP BY dtype
    """,
)
def _(spark, folder):
    path = scratch_path(spark, "schema")
    sinks.write_schema(table(spark, folder, "orders"), path)
    written = spark.read.schema("dtype string, columns array<string>").json(path)
    return written.select("dtype", F.array_join("columns", ",").alias("columns"))


@query("ground_truth", f"WITH {SQL_PARTS} SELECT doc_id, is_bad::INTEGER AS is_bad, part FROM parts")
def _(spark, folder):
    path = scratch_path(spark, "truth")
    parts = splits.train_val_test_split(targets(spark, folder), "is_bad", "doc_id")
    sinks.write_ground_truth(parts, path, "doc_id", "is_bad")
    return spark.read.schema("doc_id long, is_bad int, part string").csv(path)


@query(
    "fold_ground_truth",
    f"WITH {SQL_FOLDS} SELECT doc_id, is_bad::INTEGER AS is_bad, fold::INTEGER AS fold FROM folds",
)
def _(spark, folder):
    path = scratch_path(spark, "fold-truth")
    folds = splits.stratified_folds(targets(spark, folder), "is_bad", "doc_id")
    sinks.write_ground_truth(folds, path, "doc_id", "is_bad", by="fold")
    return spark.read.schema("doc_id long, is_bad int, fold int").csv(path)


LANGS = {"en": 1, "de": 2, "fr": 2, "OTHER": 3, "": 0}
SQL_LANGS = "CASE coalesce(lang, '') WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN '' THEN 0 ELSE 3 END"


@query(
    "feature_table",
    f"""
    WITH {SQL_DOCS}
    SELECT doc_id, is_bad, {SQL_LANGS} AS lang, n_chars, {sql_stat_columns('text')}, {sql_stat_columns('source')} FROM docs
    """,
)
def _(spark, folder):
    path = scratch_path(spark, "features")
    coded = labelled(spark, folder).withColumn("lang", encode.recode(F.col("lang"), LANGS))
    counted = stats.with_text_stats(coded, ["text", "source"]).drop("text", "source")
    sinks.write_features(counted, path)
    return rounded(spark.read.parquet(path))


# --- Projection, filter, missing values ---------------------------------------------


@query(
    "partition_shapes",
    f"WITH {SQL_PARTS} SELECT part, count(*) AS n_rows, 3 AS n_columns FROM parts GROUP BY part",
)
def _(spark, folder):
    parts = splits.train_val_test_split(targets(spark, folder), "is_bad", "doc_id")
    return parts.groupBy("part").agg(F.count("*").alias("n_rows"), F.lit(len(parts.columns)).alias("n_columns"))


@query("non_null_text", f"WITH {SQL_GAPS} SELECT doc_id, quality FROM gaps WHERE text IS NOT NULL AND quality IS NOT NULL")
def _(spark, folder):
    kept = with_gaps(spark, folder).filter(F.col("text").isNotNull() & F.col("quality").isNotNull())
    return kept.select("doc_id", "quality")


@query("head_n", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def _(spark, folder):
    return table(spark, folder, "orders").orderBy("o_orderkey").limit(20)


@query(
    "fill_missing",
    f"WITH {SQL_GAPS} SELECT doc_id, coalesce(quality::VARCHAR, 'm') AS quality, coalesce(toxic::VARCHAR, '') AS toxic FROM gaps",
)
def _(spark, folder):
    texts = with_gaps(spark, folder).select(
        "doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic")
    )
    return texts.na.fill({"quality": "m", "toxic": ""})


# --- Joins and set operations ---------------------------------------------------------


@query(
    "semi_join_ids",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
)
def _(spark, folder):
    ids = table(spark, folder, "customer").filter(F.col("c_acctbal") > 5000)
    ids = ids.select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(ids, "o_custkey", "left_semi")


@query("anti_join_ids", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, folder):
    ids = table(spark, folder, "labels").select("doc_id")
    return table(spark, folder, "documents").select("doc_id", "lang").join(ids, "doc_id", "left_anti")


@query(
    "feature_concat",
    f"""
    WITH {SQL_DOCS}
    SELECT doc_id, unnest(['n_chars', 'is_bad', 'length']) AS feature,
      unnest([n_chars::DOUBLE, is_bad::DOUBLE, length(text)::DOUBLE]) AS value FROM docs
    """,
)
def _(spark, folder):
    left = table(spark, folder, "documents").select("doc_id", "n_chars", F.length("text").alias("length"))
    both = left.join(targets(spark, folder), "doc_id")
    numbers = both.select("doc_id", *[F.col(c).cast("double").alias(c) for c in ("n_chars", "is_bad", "length")])
    return numbers.unpivot(["doc_id"], ["n_chars", "is_bad", "length"], "feature", "value")


@query("aligned_assign", f"WITH {SQL_GAPS} SELECT doc_id, (quality * 10 + toxic)::BIGINT AS code FROM gaps")
def _(spark, folder):
    derived = table(spark, folder, "labels").select(
        "doc_id", (F.col("quality") * 10 + F.col("toxic")).cast("long").alias("code")
    )
    return table(spark, folder, "documents").select("doc_id").join(derived, "doc_id", "left")


@query(
    "union_parts",
    f"WITH {SQL_PARTS} SELECT doc_id, part FROM parts WHERE part = 'train' UNION ALL SELECT doc_id, part FROM parts WHERE part = 'val'",
)
def _(spark, folder):
    parts = splits.train_val_test_split(targets(spark, folder), "is_bad", "doc_id").select("doc_id", "part")
    return parts.filter(F.col("part") == "train").unionByName(parts.filter(F.col("part") == "val"))


# --- Splits and folds -------------------------------------------------------------------


@query(
    "stratified_split",
    f"""
    WITH {SQL_TARGETS},
    counts AS (SELECT is_bad, count(*) AS size FROM targets GROUP BY is_bad),
    {sql_quotas('counts', 'size', 'quota', 'quotas')},
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY is_bad ORDER BY md5('28:' || doc_id::VARCHAR), doc_id) AS r FROM targets)
    SELECT doc_id, is_bad, CASE WHEN r <= quota THEN 'train' ELSE 'holdout' END AS part FROM ranked JOIN quotas USING (is_bad)
    """,
)
def _(spark, folder):
    return splits.stratified_split(targets(spark, folder), "is_bad", "doc_id")


@query("train_val_test", f"WITH {SQL_PARTS} SELECT * FROM parts")
def _(spark, folder):
    return splits.train_val_test_split(targets(spark, folder), "is_bad", "doc_id")


@query(
    "random_folds",
    """
    WITH r AS (
      SELECT o_orderkey, row_number() OVER (ORDER BY md5('28:' || o_orderkey::VARCHAR), o_orderkey) - 1 AS r,
        count(*) OVER () // 5 AS size FROM orders)
    SELECT o_orderkey, (r // size)::INTEGER AS fold FROM r WHERE r < size * 5
    """,
)
def _(spark, folder):
    return splits.random_folds(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@query("stratified_folds", f"WITH {SQL_FOLDS} SELECT doc_id, is_bad, fold FROM folds")
def _(spark, folder):
    return splits.stratified_folds(targets(spark, folder), "is_bad", "doc_id")


@query(
    "fold_train_test_counts",
    f"""
    WITH {SQL_FOLDS}
    SELECT fold, count(*) AS test_rows, (SELECT count(*) FROM folds) - count(*) AS train_rows,
      sum(is_bad)::BIGINT AS test_positives FROM folds GROUP BY fold
    """,
)
def _(spark, folder):
    folds = splits.stratified_folds(targets(spark, folder), "is_bad", "doc_id")
    return splits.fold_side_counts(folds, [F.sum("is_bad").alias("test_positives")])


@query(
    "shuffled_kfold",
    """
    SELECT o_orderkey, (ntile(5) OVER (ORDER BY md5('239:' || o_orderkey::VARCHAR), o_orderkey) - 1)::INTEGER AS fold
    FROM orders
    """,
)
def _(spark, folder):
    return splits.shuffled_folds(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


# --- Recoding ---------------------------------------------------------------------------


def _codes(priorities):
    return {p: i for i, p in enumerate(priorities, start=1)}


@query(
    "map_with_default",
    """
    SELECT o_orderkey, CASE nullif(o_orderpriority, '5-LOW') WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2
      WHEN '3-MEDIUM' THEN 3 ELSE (CASE WHEN nullif(o_orderpriority, '5-LOW') IS NULL THEN 0 ELSE 6 END) END AS code
    FROM orders
    """,
)
def _(spark, folder):
    codes = {**_codes(("1-URGENT", "2-HIGH", "3-MEDIUM")), "OTHER": 6, "": 0}
    gaps = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return table(spark, folder, "orders").select("o_orderkey", encode.recode(gaps, codes).alias("code"))


@query(
    "map_merge",
    """
    SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS code FROM events
    """,
)
def _(spark, folder):
    codes = {"click": 1, "view": 1, "error": 2, "OTHER": 3, "": 0}
    return table(spark, folder, "events").select("event_id", encode.recode(F.col("event_type"), codes).alias("code"))


@query(
    "map_no_missing_key",
    """
    SELECT c_custkey, coalesce(CASE nullif(c_mktsegment, 'BUILDING') WHEN 'HOUSEHOLD' THEN 0 WHEN 'MACHINERY' THEN 1
      WHEN 'FURNITURE' THEN 2 END, 4) AS code FROM customer
    """,
)
def _(spark, folder):
    codes = {"HOUSEHOLD": 0, "MACHINERY": 1, "FURNITURE": 2, "OTHER": 4}
    gaps = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return table(spark, folder, "customer").select("c_custkey", encode.recode(gaps, codes).alias("code"))


# --- Profiles -----------------------------------------------------------------------------

GAP_COLUMNS = ("text", "lang", "n_chars", "quality", "toxic")


@query(
    "null_counts",
    f"WITH {SQL_GAPS} "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM gaps" for c in GAP_COLUMNS),
)
def _(spark, folder):
    return profile.null_counts(with_gaps(spark, folder), GAP_COLUMNS)


def with_nan(spark, folder):
    """``events.value`` with NaN instead of every value below 10; the rest as it is."""
    value = F.when(F.col("value") < 10, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, folder, "events").select("event_id", value.alias("value"))


@query(
    "null_counts_nan",
    """
    SELECT 'event_id' AS "column", count(*) - count(event_id) AS nulls FROM events
    UNION ALL SELECT 'value', count(*) - count(CASE WHEN value >= 10 THEN value END) FROM events
    """,
)
def _(spark, folder):
    return profile.null_counts(with_nan(spark, folder), ["event_id", "value"])


@query(
    "describe_nan",
    """
    SELECT 'value' AS "column", count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min,
      round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS q2, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS max
    FROM (SELECT CASE WHEN value >= 10 THEN value END AS v FROM events)
    """,
)
def _(spark, folder):
    numbers = profile.describe_numeric(with_nan(spark, folder), ["value"])
    return numbers.select("column", "count", *[F.round(c, 6).alias(c) for c in numbers.columns[2:]])


@query(
    "folds_by_name",
    """
    SELECT c_name, c_nationkey, (ntile(5) OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1)::INTEGER AS fold FROM customer
    """,
)
def _(spark, folder):
    # Keys are texts.
    return splits.stratified_folds(table(spark, folder, "customer").select("c_name", "c_nationkey"), "c_nationkey", "c_name")


@query(
    "value_counts",
    """
    SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM customer GROUP BY 2
    UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, count(*) FROM customer GROUP BY 2
    """,
)
def _(spark, folder):
    orders = profile.value_counts(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])
    customers = profile.value_counts(table(spark, folder, "customer"), ["c_mktsegment", "c_nationkey"])
    return profile.ascending(orders.unionByName(customers))


@query(
    "distinct_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM orders"
        for c in ("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    ),
)
def _(spark, folder):
    return profile.distinct_counts(
        table(spark, folder, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
    )


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def sql_describe(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        round(min({c}), 6)::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6)::DOUBLE AS q1, round(quantile_cont({c}, 0.5), 6)::DOUBLE AS q2,
        round(quantile_cont({c}, 0.75), 6)::DOUBLE AS q3, round(max({c}), 6)::DOUBLE AS max FROM {source}"""
        for c in columns
    )


@query("describe_numeric", sql_describe("lineitem", NUMBERS))
def _(spark, folder):
    return rounded(profile.describe_numeric(table(spark, folder, "lineitem"), NUMBERS))


@query(
    "profile_report",
    f"""
    WITH described AS ({sql_describe('orders', ['o_totalprice'])}),
    counts AS (
      SELECT 'o_orderstatus' AS c, o_orderstatus AS v, count(*)::DOUBLE AS n FROM orders GROUP BY 2
      UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*)::DOUBLE FROM orders GROUP BY 2)
    SELECT c AS "column", 'count:' || v AS stat, n AS value FROM counts
    UNION ALL SELECT c, 'distinct', count(*)::DOUBLE FROM counts GROUP BY c
    UNION ALL SELECT unnest(['o_orderstatus', 'o_orderpriority', 'o_totalprice']), 'nulls', 0.0::DOUBLE
    UNION ALL SELECT "column", unnest(['count', 'mean', 'std', 'min', 'q1', 'q2', 'q3', 'max']),
      unnest([count::DOUBLE, mean, std, min, q1, q2, q3, max]) FROM described
    """,
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    return rounded(profile.profile(orders, ["o_orderstatus", "o_orderpriority"], ["o_totalprice"]))


# --- Classes --------------------------------------------------------------------------------


@query("class_percent", f"WITH {SQL_TARGETS} SELECT round(100.0::DOUBLE * sum(is_bad) / count(*), 2) AS percent FROM targets")
def _(spark, folder):
    return classify.class_percent(targets(spark, folder), "is_bad")


SQL_WEIGHTS = f"""{SQL_TARGETS},
weights AS (
  SELECT is_bad, (SELECT count(*) FROM targets)::DOUBLE / ((SELECT count(DISTINCT is_bad) FROM targets) * count(*)) AS weight
  FROM targets GROUP BY is_bad)"""


@query("class_weights", f"WITH {SQL_WEIGHTS} SELECT is_bad, round(weight, 6) AS weight FROM weights")
def _(spark, folder):
    return rounded(classify.balanced_weights(targets(spark, folder), "is_bad"))


@query(
    "weighted_rows",
    f"""
    WITH {SQL_WEIGHTS}
    SELECT doc_id, is_bad, CASE is_bad WHEN 0 THEN 57.0 ELSE 386.0 END::DOUBLE AS fixed, round(weight, 6) AS balanced
    FROM targets JOIN weights USING (is_bad)
    """,
)
def _(spark, folder):
    rows = targets(spark, folder)
    fixed = classify.with_class_weights(rows, "is_bad", classify.FIXED_WEIGHTS).withColumnRenamed("weight", "fixed")
    both = classify.with_class_weights(fixed, "is_bad", "balanced")
    return rounded(both.withColumnRenamed("weight", "balanced"))
