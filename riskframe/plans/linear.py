"""Linear models on three numbers of a text, solved by Newton steps on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import stats, text
from riskframe.operators import linear, metrics, splits
from riskframe.operators.classify import FIXED_WEIGHTS
from riskframe.plans.judging import NINE, SQL_DECIDED, sql_areas, sql_cells
from riskframe.plans.registry import query
from riskframe.plans.tables import SQL_PARTS, documents, targets
from riskframe.plans.texts import rounded, sql_stat
from riskframe.session import checkpointed

NUMBERS = ("n_chars", "mean_word_length", "punctuation_percent")
C = 0.1
STEPS = 30


def numbers(spark, folder):
    """``(doc_id, is_bad, part, NUMBERS)`` of the labelled documents."""
    parts = checkpointed(splits.train_val_test_split(targets(spark, folder), "is_bad", "doc_id"))
    rows = documents(spark, folder).join(parts, "doc_id").withColumn("_w", text.words(F.col("text")))
    return rows.select(
        "doc_id", "is_bad", "part", "n_chars", *[stats.pick(c, F.col("text"), F.col("_w")).alias(c) for c in NUMBERS[1:]]
    )


SQL_NUMBERS = f"""{SQL_PARTS},
numbers AS (
  SELECT doc_id, is_bad, part, n_chars::DOUBLE AS n_chars,
    list_avg(list_transform(w, lambda x: length(x))) AS mean_word_length,
    (length(text) - length(regexp_replace(text, '[!-/:-@\\[-`{{-~]', '', 'g'))) * 100.0::DOUBLE / nullif(len(w), 0)
      AS punctuation_percent
  FROM (SELECT *, {sql_stat('word_count', 'text').removeprefix('len(').removesuffix(')::BIGINT')} AS w FROM documents)
  JOIN parts USING (doc_id))"""


def sql_scaled(source: str, name: str, learns: str) -> str:
    """CTE ``name``: ``source(k, doc_id, is_bad, NUMBERS)`` imputed and scaled by the rows of model k that ``learns`` holds for."""
    mean = ", ".join(f"avg({c}) AS m_{c}" for c in NUMBERS)
    filled = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in NUMBERS)
    spread = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in NUMBERS)
    scaled = ", ".join(
        f"({c} - a_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END AS x{i}" for i, c in enumerate(NUMBERS, 1)
    )
    return f"""
{name}_mean AS (SELECT k, {mean} FROM {source} WHERE {learns} GROUP BY k),
{name}_full AS (SELECT * EXCLUDE ({', '.join(NUMBERS)}), {filled} FROM {source} JOIN {name}_mean USING (k)),
{name}_spread AS (SELECT k, {spread} FROM {name}_full WHERE {learns} GROUP BY k),
{name} AS (SELECT *, {scaled} FROM {name}_full JOIN {name}_spread USING (k))"""


def sql_newton(source: str, name: str, loss: str = "logistic", weighted: bool = True, strength: float = C) -> str:
    """CTE ``name(k, step, b0..b3)``: Newton steps for every model of ``source(k, is_bad, x1..x3)``.

    The intercept b0 is penalised. The four equations of a step are solved by a Cholesky decomposition.
    """
    size = len(NUMBERS) + 1
    weight = f"CASE is_bad WHEN 0 THEN {FIXED_WEIGHTS[0]} ELSE {FIXED_WEIGHTS[1]} END" if weighted else "1"
    z = " + ".join(f"b{i} * x{i}" for i in range(size))
    if loss == "logistic":
        slope, curve = "p - is_bad", "p * (1 - p)"
    else:
        slope = "CASE WHEN s * z < 1 THEN 2 * (z - s) ELSE 0 END"
        curve = "CASE WHEN s * z < 1 THEN 2 ELSE 0 END"
    sums = [f"b{i} + sum(r * x{i}) AS g{i}" for i in range(size)]
    sums += [f"{int(i == j)} + sum(h * x{i} * x{j}) AS h{i}{j}" for i in range(size) for j in range(i + 1)]
    chain = []
    for i in range(size):
        for j in range(i + 1):
            rest = "".join(f" - l{i}{m} * l{j}{m}" for m in range(j))
            chain.append(f"sqrt(h{i}{j}{rest}) AS l{i}{j}" if i == j else f"(h{i}{j}{rest}) / l{j}{j} AS l{i}{j}")
    for i in range(size):
        chain.append(f"(g{i}{''.join(f' - l{i}{m} * y{m}' for m in range(i))}) / l{i}{i} AS y{i}")
    for i in reversed(range(size)):
        chain.append(f"(y{i}{''.join(f' - l{m}{i} * d{m}' for m in range(i + 1, size))}) / l{i}{i} AS d{i}")
    bs = ", ".join(f"b{i}" for i in range(size))
    return f"""
{name} AS (
  SELECT DISTINCT k, 0 AS step, {', '.join(f'0::DOUBLE AS b{i}' for i in range(size))} FROM {source}
  UNION ALL
  SELECT k, step + 1, {', '.join(f'b{i} - d{i}' for i in range(size))}
  FROM (
    SELECT k, step, {bs}, {', '.join(chain)}
    FROM (
      SELECT k, step, {bs}, {', '.join(sums)}
      FROM (
        SELECT k, step, {bs}, x0, x1, x2, x3, {strength}::DOUBLE * ({weight}) * ({slope}) AS r, {strength}::DOUBLE * ({weight}) * ({curve}) AS h
        FROM (
          SELECT *, 1 / (1 + exp(-z)) AS p FROM (
            SELECT n.*, t.is_bad, t.x0, t.x1, t.x2, t.x3, 2 * t.is_bad - 1 AS s, {z} AS z
            FROM {name} n JOIN (SELECT *, 1::DOUBLE AS x0 FROM {source}) t USING (k))))
      GROUP BY k, step, {bs}))
  WHERE step < {STEPS})"""


SQL_SINGLE = f"""{SQL_NUMBERS},
single AS (SELECT 0 AS k, * FROM numbers),
{sql_scaled('single', 'scaled', "part = 'train'")},
learned AS (SELECT * FROM scaled WHERE part = 'train')"""
SQL_FIT = f"""{SQL_SINGLE},
{sql_newton('learned', 'newton')},
fitted AS (SELECT * FROM newton WHERE step = {STEPS})"""
SQL_SCORES = f"""{SQL_FIT},
scores AS (
  SELECT doc_id, is_bad, part, 1 / (1 + exp(-m)) AS score, (m > 0)::INTEGER AS prediction
  FROM (SELECT *, b0 + b1 * x1 + b2 * x2 + b3 * x3 AS m FROM scaled JOIN fitted USING (k)))"""


def raw(spark, folder):
    return linear.raw_rows(numbers(spark, folder), "is_bad", NUMBERS, keep=["doc_id", "part"])


def fitted(rows, loss="logistic", weights=FIXED_WEIGHTS, strength=C):
    train = rows.where("part = 'train'")
    return linear.fit_linear(train, linear.fit_scaling(train, len(NUMBERS)), strength, weights, loss)


@query(
    "fit_logreg_numbers",
    f"""
    WITH RECURSIVE {SQL_FIT}
    SELECT unnest(['(intercept)', {', '.join(f"'{c}'" for c in NUMBERS)}]) AS feature,
      round(unnest([b0, b1, b2, b3]), 6) AS coefficient
    FROM fitted
    """,
)
def _(spark, folder):
    rows = raw(spark, folder)
    return rounded(linear.coefficients(rows, fitted(rows), NUMBERS))


def scores(spark, folder):
    rows = raw(spark, folder)
    return linear.score(rows, fitted(rows), ["doc_id", "part"], "is_bad")


@query(
    "predictions_numbers",
    f"WITH RECURSIVE {SQL_SCORES} SELECT doc_id, part, is_bad, round(score, 6) AS score, prediction FROM scores",
)
def _(spark, folder):
    return rounded(scores(spark, folder))


@query(
    "metrics_numbers",
    f"""
    WITH RECURSIVE {SQL_SCORES}, s AS (SELECT * FROM scores), {sql_cells('is_bad', 'part')}, {SQL_DECIDED},
    {sql_areas('is_bad', 'part')}
    SELECT part, {', '.join(f'round({n}, 6) AS {n}' for n in NINE)} FROM decided JOIN areas USING (part)
    """,
)
def _(spark, folder):
    return rounded(metrics.binary_metrics(checkpointed(scores(spark, folder)), "is_bad", "prediction", "score", ["part"]))


SQL_FOLDED = f"""{SQL_NUMBERS},
folds AS (
  SELECT *, (ntile(5) OVER (PARTITION BY is_bad ORDER BY doc_id) - 1)::INTEGER AS fold FROM numbers WHERE part = 'train'),
each_model AS (
  SELECT k, f.* FROM range(5) AS r(k), folds f
  UNION ALL SELECT k, n.*, NULL FROM range(5) AS r(k), numbers n WHERE part = 'test'),
{sql_scaled('each_model', 'scaled', 'fold <> k')},
learned AS (SELECT * FROM scaled WHERE fold <> k),
{sql_newton('learned', 'newton')},
fitted AS (SELECT * FROM newton WHERE step = {STEPS}),
scores AS (
  SELECT k, doc_id, is_bad, part, fold, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2 + b3 * x3))) AS score
  FROM scaled JOIN fitted USING (k) WHERE fold IS NULL OR fold = k)"""


def folded(spark, folder):
    """The training rows with their fold, all rows of the table, and the five models."""
    every = checkpointed(numbers(spark, folder))
    train = splits.stratified_folds(every.where("part = 'train'"), "is_bad", "doc_id")
    rows = linear.raw_rows(train, "is_bad", NUMBERS, fold="fold", keep=["doc_id", "part"])
    return every, rows, linear.fit_folds(rows, len(NUMBERS), C=C, weights=FIXED_WEIGHTS)


@query(
    "oof_numbers",
    f"""
    WITH RECURSIVE {SQL_FOLDED}
    SELECT doc_id, part, is_bad, round(avg(score), 6) AS score FROM scores GROUP BY doc_id, part, is_bad
    """,
)
def _(spark, folder):
    every, rows, models = folded(spark, folder)
    test = linear.raw_rows(every.where("part = 'test'"), "is_bad", NUMBERS, keep=["doc_id", "part"])
    seen = linear.out_of_fold(rows, models, ["doc_id", "part"], "is_bad").drop("fold", "prediction")
    return rounded(seen.unionByName(linear.averaged(test, models, ["doc_id", "part"], "is_bad")))


@query(
    "cv_logreg_numbers",
    f"""
    WITH RECURSIVE {SQL_FOLDED}, s AS (SELECT * FROM scores WHERE fold IS NOT NULL), {sql_areas('is_bad', 'fold')}
    SELECT fold, {', '.join(f'round({n}, 6) AS {n}' for n in ('auroc', 'auprc', 'minpse', 'average_precision'))} FROM areas
    """,
)
def _(spark, folder):
    _, rows, models = folded(spark, folder)
    found = checkpointed(linear.out_of_fold(rows, models, ["doc_id"], "is_bad"))
    return rounded(metrics.curve_areas(found, "is_bad", "score", ["fold"]))


@query(
    "linear_svc_numbers",
    f"""
    WITH RECURSIVE {SQL_SINGLE}, {sql_newton('learned', 'newton', 'squared_hinge', False, 1.0)}
    SELECT doc_id, part, is_bad, round(b0 + b1 * x1 + b2 * x2 + b3 * x3, 6) AS margin
    FROM scaled JOIN newton USING (k) WHERE step = {STEPS}
    """,
)
def _(spark, folder):
    rows = raw(spark, folder)
    model = fitted(rows, "squared_hinge", None, 1.0)
    found = linear.margins(rows, model, ["doc_id", "part"])
    return rounded(found.select("doc_id", "part", F.col("_label").alias("is_bad"), F.get("margins", F.lit(0)).alias("margin")))
