"""The whole run on a loan table: from the CSV to judged predictions.

Expects the columns ``Id``, ``is_bad``, three free texts, the coded categories and the
numbers listed below; see ``FIXTURES.md``. Each stage writes one table, and the next
stage reads what was written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.functions import encode, stats, text, tokens
from riskframe.functions.wordlists import TAG_CLASSES
from riskframe.operators import classify, lexicon, linear, metrics, profile, splits, vocab
from riskframe.session import checkpointed
from riskframe.sources import sinks, tables

KEY, TARGET = "Id", "is_bad"

# The column roles of the loan table.
TEXTS = ("emp_title", "Notes", "purpose")
CATEGORIES = (
    "emp_length", "home_ownership", "verification_status", "pymnt_plan", "initial_list_status",
    "policy_code", "addr_state", "purpose_cat",
)
NUMBERS = (
    "revol_bal", "mths_since_last_major_derog", "annual_inc", "debt_to_income", "delinq_2yrs",
    "inq_last_6mths", "mths_since_last_delinq", "mths_since_last_record", "open_acc", "pub_rec",
    "revol_util", "total_acc", "collections_12_mths_ex_med",
)
MODEL_NUMBERS = (
    "revol_bal", "mths_since_last_major_derog", "annual_inc", "debt_to_income", "delinq_2yrs",
    "inq_last_6mths", "open_acc", "pub_rec", "revol_util", "total_acc",
)
RECODED = {
    "home_ownership": encode.home_ownership,
    "verification_status": encode.verification_status,
    "policy_code": encode.policy_code,
}
TAG_FEATURES = {name: f"{name}_countNotes" for name in TAG_CLASSES}
MODEL_COLUMNS = (
    *RECODED,
    *MODEL_NUMBERS,
    *(feature.format(c) for c in TEXTS for feature in stats.FEATURE_NAMES.values()),
    *TAG_FEATURES.values(),
)


def featurize(df: DataFrame) -> DataFrame:
    """Recode the categories and add ``clean_text``, text statistics and tag counts.

    One narrow pass over the rows, then the stems of the cleaned text are rewritten by the lexicon of the corpus.
    """
    coded = df.withColumns({c: code(F.col(c)) for c, code in RECODED.items()})
    counted = stats.with_text_stats(coded, TEXTS)
    tags = tokens.tag_tokens(tokens.tokenize(text.pad_punctuation(F.col("Notes"))))
    numbered = (
        counted.withColumn("_tags", tags)
        .withColumns(
            {feature: tokens.tag_class_count(F.col("_tags"), n) for n, feature in TAG_FEATURES.items()}
        )
        .drop("_tags")
    )
    return lexicon.clean_texts(numbered, "Notes", keep_source=True)


def bag_of_words(
    features: DataFrame,
    fit_on: tuple[str, ...] = ("train", "val"),
    min_df: int = 5,
    max_features: int = 10_000,
) -> DataFrame:
    """``(Id, is_bad, part, model columns, bag)``: the 0/1 vector of frequent n-grams."""
    terms = features.withColumn("_terms", vocab.bow_tokens(F.coalesce("clean_text", F.lit("m"))))
    known = vocab.ngram_vocabulary(
        terms.filter(F.col("part").isin(*fit_on)), "_terms", min_df=min_df, max_features=max_features
    )
    grams = vocab.with_ngrams(terms, "_terms", "_grams")
    bag = vocab.bow_vectorizer(checkpointed(known), "_grams", "bag")
    return bag.transform(grams).select(KEY, TARGET, "part", *MODEL_COLUMNS, "bag")


@dataclass(frozen=True)
class Judged:
    """What a run leaves: tables, all small but the scores."""

    profile: DataFrame
    weights: DataFrame
    fold_areas: DataFrame
    fold_summary: DataFrame
    roc_band: DataFrame
    metrics: DataFrame
    scores: DataFrame


def run(
    spark: SparkSession,
    csv: str,
    out: str,
    C: float = 0.1,
    weights: dict[int, float] | str | None = classify.FIXED_WEIGHTS,
    folds: int = 5,
    leaky: bool = False,
    max_features: int = 10_000,
    multi_line: bool = True,
    penalise_intercept: bool = True,
    tol: float = 1e-4,
) -> Judged:
    """Read ``csv``, write every stage under the folder ``out`` and return the results.

    The fold models are fitted in the same scans. Without ``penalise_intercept`` the intercept is free;
    ``tol`` is the share of its first value to which the gradient must fall.

    The CSV is parsed for its types and once more; all stages read the Parquet copy. Without
    ``multi_line`` a file is read in splits (its texts then hold no line breaks).
    """
    sinks.write_features(tables.read_csv(spark, csv, multi_line=multi_line), f"{out}/loans")
    loans = spark.read.parquet(f"{out}/loans")
    sinks.write_schema(loans, f"{out}/schema")
    parts = checkpointed(splits.train_val_test_split(loans.select(KEY, TARGET), TARGET, KEY))
    sinks.write_ground_truth(parts, f"{out}/ground_truth", KEY, TARGET)

    sinks.write_features(featurize(loans.join(parts.select(KEY, "part"), KEY)), f"{out}/features")
    features = spark.read.parquet(f"{out}/features")
    train_loans = loans.join(parts.filter(F.col("part") == "train").select(KEY), KEY, "left_semi")
    report = profile.profile(train_loans, CATEGORIES, NUMBERS)

    sinks.write_features(bag_of_words(features, max_features=max_features), f"{out}/model_table")
    rows = spark.read.parquet(f"{out}/model_table")
    train = rows.filter(F.col("part") == "train")

    width = linear.width_of(rows, MODEL_COLUMNS, "bag")
    options = {"C": C, "weights": weights, "penalise_intercept": penalise_intercept, "tol": tol}
    in_folds = checkpointed(splits.stratified_folds(train, TARGET, KEY, folds))
    sinks.write_ground_truth(in_folds, f"{out}/fold_ground_truth", KEY, TARGET, by="fold")
    held = linear.raw_rows(in_folds, TARGET, MODEL_COLUMNS, "bag", "fold", [KEY])
    fold_models = linear.fit_folds(held, width, folds, leaky, **options)
    out_of_fold = checkpointed(linear.out_of_fold(held, fold_models, [KEY], TARGET))

    every = linear.raw_rows(rows, TARGET, MODEL_COLUMNS, "bag", keep=[KEY, "part"])
    fit_on = every.filter(F.col("part") == "train")
    model = linear.fit_linear(fit_on, linear.fit_scaling(fit_on, width), **options)
    scores = checkpointed(linear.score(every, model, [KEY, "part"], TARGET))
    judged = metrics.binary_metrics(scores, TARGET, "prediction", "score", ["part"])
    sinks.write_metrics(judged, f"{out}/metrics")
    sinks.write_predictions(scores, f"{out}/predictions", KEY, TARGET)
    return Judged(
        profile=report,
        weights=classify.balanced_weights(train, TARGET),
        fold_areas=metrics.curve_areas(out_of_fold, TARGET, "score", ["fold"]),
        fold_summary=metrics.fold_area_summary(out_of_fold, TARGET, "score", "fold"),
        roc_band=metrics.roc_mean(metrics.roc_grid(out_of_fold, TARGET, "score", ["fold"])),
        metrics=spark.read.json(f"{out}/metrics"),
        scores=scores,
    )
