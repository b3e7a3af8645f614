"""Evaluation of scores: decisions, curves, areas, bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import metrics, splits
from riskframe.plans.registry import query
from riskframe.plans.tables import SQL_FOLDS, SQL_PARTS, table, targets
from riskframe.plans.texts import rounded
from riskframe.session import checkpointed, scratch_path
from riskframe.sources import sinks

# Scores on two inputs: documents by length (few rows, real labels), orders by price
# (many distinct scores).


def scored_documents(spark, folder, by):
    """``(doc_id, is_bad, score, prediction, by)`` by part or by fold."""
    rows = targets(spark, folder)
    split = splits.train_val_test_split if by == "part" else splits.stratified_folds
    rows = split(rows, "is_bad", "doc_id")
    lengths = table(spark, folder, "documents").select("doc_id", "n_chars")
    scored = rows.join(lengths, "doc_id").withColumn("score", F.col("n_chars") / (F.col("n_chars") + 2000))
    return scored.withColumn("prediction", (F.col("score") > 0.5).cast("int")).drop("n_chars")


def scored_orders(spark, folder):
    """``(o_orderpriority, label, score, prediction)``."""
    score = F.col("o_totalprice") / 600000.0
    return table(spark, folder, "orders").select(
        "o_orderpriority",
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        score.alias("score"),
        (score > 0.5).cast("int").alias("prediction"),
    )


def _sql_documents(base: str, rows: str) -> str:
    return f"""{base},
s AS (
  SELECT t.*, n_chars / (n_chars + 2000)::DOUBLE AS score, (n_chars / (n_chars + 2000)::DOUBLE > 0.5)::INTEGER AS prediction
  FROM {rows} t JOIN documents USING (doc_id))"""


SQL_BY_PART = _sql_documents(SQL_PARTS, "parts")
SQL_BY_FOLD = _sql_documents(SQL_FOLDS, "folds")
SQL_ORDERS = """
s AS (
  SELECT o_orderpriority, (o_orderstatus = 'F')::INTEGER AS label, o_totalprice / 600000.0::DOUBLE AS score,
    (o_totalprice / 600000.0::DOUBLE > 0.5)::INTEGER AS prediction FROM orders)"""


def sql_curve(label: str, by: str) -> str:
    return f"""
g AS (SELECT {by}, score, sum({label}) AS pos, sum(1 - {label}) AS neg FROM s GROUP BY {by}, score),
curve AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {by}) AS p,
    sum(neg) OVER (PARTITION BY {by}) AS n
  FROM g WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def sql_areas(label: str, by: str) -> str:
    """Areas from the point lists, with lag over the points; the ROC area from mid-ranks."""
    return f"""{sql_curve(label, by)},
pr AS (
  SELECT {by}, tp / p::DOUBLE AS recall, tp / (tp + fp)::DOUBLE AS prec,
    lag(tp / p::DOUBLE, 1, 0.0) OVER (PARTITION BY {by} ORDER BY score DESC) AS recall0,
    lag(tp / (tp + fp)::DOUBLE, 1, 1.0) OVER (PARTITION BY {by} ORDER BY score DESC) AS prec0
  FROM curve),
mid AS (
  SELECT {by}, {label} AS y, rank() OVER (PARTITION BY {by} ORDER BY score)
    + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0::DOUBLE AS r FROM s),
roc_area AS (
  SELECT {by}, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)) AS auroc
  FROM mid GROUP BY {by}),
areas AS (
  SELECT {by}, auroc, sum((recall - recall0) * (prec + prec0) / 2) AS auprc, max(least(recall, prec)) AS minpse,
    sum((recall - recall0) * prec) AS average_precision
  FROM pr JOIN roc_area USING ({by}) GROUP BY {by}, auroc)"""


def sql_cells(label: str, by: str) -> str:
    return f"""
cells AS (
  SELECT {by}, count(*) FILTER ({label} = 0 AND prediction = 0) AS tn, count(*) FILTER ({label} = 0 AND prediction = 1) AS fp,
    count(*) FILTER ({label} = 1 AND prediction = 0) AS fn, count(*) FILTER ({label} = 1 AND prediction = 1) AS tp
  FROM s GROUP BY {by})"""


@query(
    "confusion_matrix",
    f"""
    WITH {SQL_ORDERS}, {sql_cells('label', 'o_orderpriority')}
    SELECT o_orderpriority, unnest([0, 0, 1, 1]) AS label, unnest([0, 1, 0, 1]) AS prediction, unnest([tn, fp, fn, tp]) AS rows
    FROM cells
    """,
)
def _(spark, folder):
    return metrics.confusion_matrix(scored_orders(spark, folder), "label", "prediction", ["o_orderpriority"])


NINE = ("acc", "prec0", "prec1", "rec0", "rec1", "auroc", "auprc", "minpse", "f1scores")
SQL_DECIDED = """
decided AS (
  SELECT *, (tn + tp) / (tn + fp + fn + tp)::DOUBLE AS acc, tn / nullif(tn + fn, 0)::DOUBLE AS prec0,
    tp / nullif(tp + fp, 0)::DOUBLE AS prec1, tn / nullif(tn + fp, 0)::DOUBLE AS rec0,
    tp / nullif(tp + fn, 0)::DOUBLE AS rec1, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1scores FROM cells)"""


@query(
    "metrics_binary",
    f"""
    WITH {SQL_BY_PART}, {sql_cells('is_bad', 'part')}, {SQL_DECIDED}, {sql_areas('is_bad', 'part')}
    SELECT part, {', '.join(f'round({n}, 6) AS {n}' for n in NINE)} FROM decided JOIN areas USING (part)
    """,
)
def _(spark, folder):
    scored = scored_documents(spark, folder, "part")
    return rounded(metrics.binary_metrics(scored, "is_bad", "prediction", "score", ["part"]))


@query(
    "roc_curve",
    f"""
    WITH {SQL_BY_PART}, {sql_curve('is_bad', 'part')}
    SELECT part, round(score, 6) AS threshold, round(fp / n::DOUBLE, 6) AS fpr, round(tp / p::DOUBLE, 6) AS tpr FROM curve
    UNION ALL SELECT DISTINCT part, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM s
    """,
)
def _(spark, folder):
    return rounded(metrics.roc_curve(scored_documents(spark, folder, "part"), "is_bad", "score", ["part"]))


@query(
    "pr_curve",
    f"""
    WITH {SQL_BY_PART}, {sql_curve('is_bad', 'part')}
    SELECT part, round(score, 6) AS threshold, round(tp / p::DOUBLE, 6) AS recall, round(tp / (tp + fp)::DOUBLE, 6) AS precision
    FROM curve WHERE tp - pos < p
    UNION ALL SELECT DISTINCT part, NULL::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM s
    """,
)
def _(spark, folder):
    return rounded(metrics.pr_curve(scored_documents(spark, folder, "part"), "is_bad", "score", ["part"]))


def _register_area(name: str, column: str) -> None:
    @query(
        name,
        f"""
        WITH {SQL_ORDERS}, {sql_areas('label', 'o_orderpriority')}
        SELECT o_orderpriority, round({column}, 6) AS {column} FROM areas
        """,
    )
    def _(spark, folder):
        return rounded(
            metrics.curve_areas(scored_orders(spark, folder), "label", "score", ["o_orderpriority"], only=[column])
        )


for _name, _column in (
    ("auroc", "auroc"), ("auprc", "auprc"), ("min_pse", "minpse"), ("average_precision", "average_precision"),
):
    _register_area(_name, _column)


@query(
    "classification_report",
    f"""
    WITH {SQL_BY_PART}, {sql_cells('is_bad', 'part')},
    classes AS (
      SELECT part, '0' AS class, tn AS r, fn AS fa, fp AS mi FROM cells
      UNION ALL SELECT part, '1', tp, fp, fn FROM cells),
    scores AS (
      SELECT part, class, coalesce(r / nullif(r + fa, 0)::DOUBLE, 0) AS precision, coalesce(r / nullif(r + mi, 0)::DOUBLE, 0) AS recall,
        coalesce(2 * r / nullif(2 * r + fa + mi, 0)::DOUBLE, 0) AS f1, r + mi AS support FROM classes),
    averages AS (
      SELECT part, 'macro avg' AS class, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, sum(support)::BIGINT AS support
      FROM scores GROUP BY part
      UNION ALL SELECT part, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support)::BIGINT FROM scores GROUP BY part)
    SELECT part, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
    FROM (SELECT * FROM scores UNION ALL SELECT * FROM averages)
    """,
)
def _(spark, folder):
    scored = scored_documents(spark, folder, "part")
    return rounded(metrics.classification_report(scored, "is_bad", "prediction", ["part"]))


# The grid by brute force: for every fold and place, the last curve point not right of
# it and the first one right of it.
SQL_GRID = f"""{SQL_BY_FOLD}, {sql_curve('is_bad', 'fold')},
points AS (SELECT fold, fp, tp, n, p FROM curve UNION ALL SELECT DISTINCT fold, 0, 0, n, p FROM curve),
places AS (SELECT fold, n, p, k FROM (SELECT DISTINCT fold, n, p FROM points), unnest(range(100)) AS u(k)),
lefts AS (
  SELECT a.fold, a.k, a.n, a.p, max(b.fp) AS fp0, max(b.tp) AS tp0
  FROM places a JOIN points b ON a.fold = b.fold AND b.fp * 99 <= a.k * a.n GROUP BY ALL),
rights AS (
  SELECT a.fold, a.k, min(b.fp) AS fp1, min(b.tp) AS tp1
  FROM places a JOIN points b ON a.fold = b.fold AND b.fp * 99 > a.k * a.n GROUP BY ALL),
grid AS (
  SELECT fold, k::INTEGER AS grid, k / 99::DOUBLE AS fpr, CASE WHEN k = 0 THEN 0.0 WHEN fp1 IS NULL THEN tp0 / p::DOUBLE
    ELSE (tp0 + (tp1 - tp0) * (k * n / 99::DOUBLE - fp0) / (fp1 - fp0)) / p END AS tpr
  FROM lefts LEFT JOIN rights USING (fold, k))"""
SQL_MEAN = f"""{SQL_GRID},
means AS (
  SELECT grid, fpr, CASE WHEN grid = 99 THEN 1.0 ELSE avg(tpr) END AS mean_tpr, stddev_pop(tpr) AS std_tpr
  FROM grid GROUP BY grid, fpr)"""


def fold_grid(spark, folder):
    return metrics.roc_grid(scored_documents(spark, folder, "fold"), "is_bad", "score", ["fold"])


@query("roc_grid", f"WITH {SQL_GRID} SELECT fold, grid, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM grid")
def _(spark, folder):
    return rounded(fold_grid(spark, folder))


@query(
    "roc_mean",
    f"""
    WITH {SQL_MEAN}
    SELECT round(sum((mean_tpr + mean0) / 2 * (fpr - fpr0)), 6) AS mean_auc FROM (
      SELECT *, lag(mean_tpr) OVER (ORDER BY grid) AS mean0, lag(fpr) OVER (ORDER BY grid) AS fpr0 FROM means)
    """,
)
def _(spark, folder):
    return rounded(metrics.roc_mean_area(metrics.roc_mean(fold_grid(spark, folder))))


@query(
    "roc_band",
    f"""
    WITH {SQL_MEAN}
    SELECT grid, round(fpr, 6) AS fpr, round(mean_tpr, 6) AS mean_tpr, round(std_tpr, 6) AS std_tpr,
      round(greatest(mean_tpr - std_tpr, 0), 6) AS lower, round(least(mean_tpr + std_tpr, 1), 6) AS upper FROM means
    """,
)
def _(spark, folder):
    return rounded(metrics.roc_mean(fold_grid(spark, folder)))


@query(
    "roc_fold_summary",
    f"""
    WITH {SQL_MEAN},
    mid AS (
      SELECT fold, is_bad AS y, rank() OVER (PARTITION BY fold ORDER BY score)
        + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0::DOUBLE AS r FROM s),
    areas AS (
      SELECT fold, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)) AS auroc FROM mid GROUP BY fold)
    SELECT round(mean_auc, 6) AS mean_auc, round(std_auc, 6) AS std_auc FROM (
      SELECT sum((mean_tpr + mean0) / 2 * (fpr - fpr0)) AS mean_auc FROM (
        SELECT *, lag(mean_tpr) OVER (ORDER BY grid) AS mean0, lag(fpr) OVER (ORDER BY grid) AS fpr0 FROM means)),
      (SELECT stddev_pop(auroc) AS std_auc FROM areas)
    """,
)
def _(spark, folder):
    scored = checkpointed(scored_documents(spark, folder, "fold"))
    return rounded(metrics.fold_area_summary(scored, "is_bad", "score", "fold"))


@query(
    "metrics_file",
    f"""
    WITH {SQL_BY_PART}, {sql_cells('is_bad', 'part')}, {SQL_DECIDED}, {sql_areas('is_bad', 'part')}
    SELECT part, {', '.join(f'round({n}, 6) AS {n}' for n in NINE)} FROM decided JOIN areas USING (part)
    """,
)
def _(spark, folder):
    # Written as JSON records and read back.
    path = scratch_path(spark, "metrics")
    scored = scored_documents(spark, folder, "part")
    sinks.write_metrics(metrics.binary_metrics(scored, "is_bad", "prediction", "score", ["part"]), path)
    return rounded(spark.read.json(path)).select("part", *NINE)


@query(
    "predictions_file",
    """
    SELECT doc_id, printf('%.6f', n_chars / (n_chars + 2000)::DOUBLE) AS prediction, (1 - quality)::INTEGER AS y_true
    FROM documents JOIN labels USING (doc_id)
    """,
)
def _(spark, folder):
    # Written as headered CSV and read back.
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(scored_documents(spark, folder, "part"), path, "doc_id", "is_bad", "score")
    return spark.read.csv(path, header=True, schema="doc_id long, prediction string, y_true int")


@query(
    "cohen_kappa",
    f"""
    WITH {SQL_ORDERS}, {sql_cells('label', 'o_orderpriority')},
    shares AS (
      SELECT o_orderpriority, tn + fp + fn + tp AS n, (tn + tp) / n::DOUBLE AS observed,
        ((tn + fp) / n::DOUBLE) * ((tn + fn) / n::DOUBLE) + ((tp + fn) / n::DOUBLE) * ((tp + fp) / n::DOUBLE) AS chance FROM cells)
    SELECT o_orderpriority, round((observed - chance) / (1 - chance), 6) AS kappa FROM shares
    """,
)
def _(spark, folder):
    return rounded(metrics.cohen_kappa(scored_orders(spark, folder), "label", "prediction", ["o_orderpriority"]))


@query(
    "fbeta",
    f"""
    WITH {SQL_ORDERS},
    sums AS (
      SELECT o_orderpriority, sum(round_even(least(greatest(label * score, 0), 1), 0)) AS tp,
        sum(round_even(least(greatest(score, 0), 1), 0)) AS predicted, sum(label) AS positive FROM s GROUP BY 1),
    pr AS (SELECT *, tp / (predicted + 1e-7) AS precision, tp / (positive + 1e-7) AS recall FROM sums)
    SELECT o_orderpriority, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(CASE WHEN positive = 0 THEN 0 ELSE 5 * precision * recall / (4 * precision + recall + 1e-7) END, 6) AS fbeta FROM pr
    """,
)
def _(spark, folder):
    return rounded(
        metrics.soft_fbeta(scored_orders(spark, folder), "label", "score", beta=2.0, by=["o_orderpriority"])
    )


@query(
    "weighted_log_loss",
    f"""
    WITH {SQL_ORDERS},
    clipped AS (SELECT o_orderpriority, greatest(label, 1e-7::DOUBLE) AS y, least(greatest(score, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS p FROM s)
    SELECT o_orderpriority, round(avg(-(y * ln(p) * 6.8::DOUBLE + (1 - y) * ln(1 - p))), 6) AS log_loss FROM clipped GROUP BY 1
    """,
)
def _(spark, folder):
    return rounded(
        metrics.weighted_log_loss(scored_orders(spark, folder), "label", "score", 6.8, by=["o_orderpriority"])
    )


@query("round_to_class", "SELECT o_orderkey, round_even(o_totalprice / 600000.0::DOUBLE, 0)::INTEGER AS class FROM orders")
def _(spark, folder):
    score = F.col("o_totalprice") / 600000.0
    return table(spark, folder, "orders").select("o_orderkey", metrics.round_to_class(score).alias("class"))
