"""The test tables as the loan table they stand in for.

``documents`` joined with ``labels`` plays the loan table: ``doc_id`` is the key,
``text`` the notes and ``is_bad = 1 - quality`` the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F



def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# A caller whose files are too few for its cores says here into how many parts texts are dealt.
PARTS = "riskframe.input.partitions"


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` as it is scanned, unless the session asks for a number of parts."""
    parts = df.sparkSession.conf.get(PARTS, None)
    return df.repartition(int(parts), key) if parts else df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(table(spark, folder, "documents"), "doc_id")


def targets(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, is_bad)``: the narrow table that splits and folds work on."""
    labels = table(spark, folder, "labels")
    known = table(spark, folder, "documents").select("doc_id")
    return labels.join(known, "doc_id", "left_semi").select(
        "doc_id", (1 - F.col("quality")).cast("int").alias("is_bad")
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """All document columns with the target, for labelled documents."""
    labels = table(spark, folder, "labels").select(
        "doc_id", (1 - F.col("quality")).cast("int").alias("is_bad")
    )
    return documents(spark, folder).join(labels, "doc_id")


def with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """All documents; ``quality`` and ``toxic`` are null where there is no label."""
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")


# The same tables for DuckDB.
SQL_TARGETS = """
targets AS (
  SELECT l.doc_id, 1 - l.quality AS is_bad FROM labels l WHERE l.doc_id IN (SELECT doc_id FROM documents)
)"""
SQL_DOCS = """
docs AS (SELECT d.*, 1 - l.quality AS is_bad FROM documents d JOIN labels l USING (doc_id))"""
SQL_GAPS = """
gaps AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"""


def sql_quotas(source: str, size: str, name: str, result: str) -> str:
    """A CTE ``result``: ``source`` plus how many rows of each class are kept."""
    return f"""
{result}_a AS (
  SELECT *, sum({size}) OVER () AS n_, sum({size}) OVER () - ceil(0.3::DOUBLE * sum({size}) OVER ())::HUGEINT AS kept_
  FROM {source}),
{result}_b AS (SELECT *, (kept_ * {size}) // n_ AS floor_, (kept_ * {size}) % n_ AS mod_ FROM {result}_a),
{result} AS (
  SELECT * EXCLUDE (n_, kept_, floor_, mod_), floor_ + CASE WHEN row_number() OVER (ORDER BY mod_ DESC, is_bad)
    <= kept_ - sum(floor_) OVER () THEN 1 ELSE 0 END AS {name}
  FROM {result}_b)"""


# Parts of the labelled documents: (doc_id, is_bad, part).
SQL_PARTS = f"""{SQL_TARGETS},
counts AS (SELECT is_bad, count(*) AS size FROM targets GROUP BY is_bad),
{sql_quotas('counts', 'size', 'train_rows', 'first_quota')},
rest AS (SELECT *, size - train_rows AS rest_rows FROM first_quota),
{sql_quotas('rest', 'rest_rows', 'val_rows', 'quotas')},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY is_bad ORDER BY md5('28:' || doc_id::VARCHAR), doc_id) AS r FROM targets),
parts AS (
  SELECT doc_id, is_bad, CASE WHEN r <= train_rows THEN 'train' WHEN r <= train_rows + val_rows THEN 'val'
    ELSE 'test' END AS part
  FROM ranked JOIN quotas USING (is_bad))"""
SQL_FOLDS = f"""{SQL_TARGETS},
folds AS (
  SELECT *, (ntile(5) OVER (PARTITION BY is_bad ORDER BY doc_id) - 1)::INTEGER AS fold FROM targets)"""
