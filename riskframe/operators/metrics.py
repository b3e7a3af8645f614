"""Exact evaluation of binary classifiers as distributed aggregates.

Labels are 0 or 1. Scores grow with the belief in class 1. All operators work per
group of the columns ``by`` (parts, folds); without ``by`` the table is one group.
Rows with one score always move together, so the result does not depend on order.
Divisions by zero give null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.operators.rank import range_totals
from riskframe.session import checkpointed


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


# --- Curves ---------------------------------------------------------------------


def score_counts(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), **sums: Column
) -> DataFrame:
    """``(by, score, pos, neg)``: rows of each class for every distinct score."""
    positive = F.col(label) == 1
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(positive).alias("pos"),
        F.count_if(~positive).alias("neg"),
        *[F.sum(c).alias(n) for n, c in sums.items()],
    )


def curve_counts(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    parts: int | None = None,
    **sums: Column,
) -> DataFrame:
    """Score counts with ``tp`` and ``fp`` at the threshold ``score``, ``pos_all``, ``neg_all``."""
    # Computed once: whatever produced the scores is not run again for the ranges.
    counts = checkpointed(score_counts(df, label, score, by, **sums))
    totals = range_totals(counts, {"tp": F.col("pos"), "fp": F.col("neg")}, [F.col("score").desc()], by, parts)
    return totals.withColumnsRenamed({"tp_all": "pos_all", "fp_all": "neg_all"})


def _origin(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group of curve counts: that of its highest score, where step and sum agree."""
    if not by:
        return counts.sparkSession.range(1).select()
    return counts.filter((F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))).select(*by)


def roc_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by, threshold, fpr, tpr)``: one point per distinct score, and the point (0, 0).

    The first point has no threshold (null).
    """
    counts = curve_counts(df, label, score, by)
    points = counts.select(
        *by,
        F.col("score").cast("double").alias("threshold"),
        _ratio(F.col("fp"), F.col("neg_all")).alias("fpr"),
        _ratio(F.col("tp"), F.col("pos_all")).alias("tpr"),
    )
    start = _origin(counts, by).select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(start)


def pr_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by, threshold, recall, precision)`` down to the first full recall.

    The end point (recall 0, precision 1) has no threshold (null).
    """
    counts = curve_counts(df, label, score, by)
    points = (
        counts.filter(F.col("tp") - F.col("pos") < F.col("pos_all"))
        .select(
            *by,
            F.col("score").cast("double").alias("threshold"),
            _ratio(F.col("tp"), F.col("pos_all")).alias("recall"),
            _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        )
    )
    end = _origin(counts, by).select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("recall"),
        F.lit(1.0).alias("precision"),
    )
    return points.unionByName(end)


def _area_terms() -> Mapping[str, Column]:
    """Aggregates over curve counts. Each row carries its own step, so no lag is needed."""
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    pos_all, neg_all = F.col("pos_all").cast("double"), F.col("neg_all").cast("double")
    precision = F.try_divide(tp, tp + fp)
    before = F.coalesce(F.try_divide(tp - pos, tp - pos + fp - neg), F.lit(1.0))
    recall = F.try_divide(tp, pos_all)
    reaches = F.when(pos_all > 0, F.least(precision, recall))
    return {
        "auroc": F.try_divide(F.sum(neg * (tp - pos / 2)), F.max(pos_all) * F.max(neg_all)),
        "auprc": F.try_divide(F.sum(pos * (precision + before) / 2), F.max(pos_all)),
        "minpse": F.max(reaches),
        "average_precision": F.try_divide(F.sum(pos * precision), F.max(pos_all)),
    }


def curve_areas(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    only: Sequence[str] = ("auroc", "auprc", "minpse", "average_precision"),
) -> DataFrame:
    """``(by, auroc, auprc, minpse, average_precision)``, or those named in ``only``.

    auroc and auprc are trapezoid areas, average_precision the step sum, minpse
    the largest min(precision, recall) over the thresholds.
    """
    terms = _area_terms()
    return curve_counts(df, label, score, by).groupBy(*by).agg(*[terms[n].alias(n) for n in only])


def roc_grid(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), points: int = 100
) -> DataFrame:
    """``(by, grid, fpr, tpr)``: the ROC curve at ``points`` even places from 0 to 1.

    Linear between curve points; on a vertical step the highest value counts; the
    value at 0 is set to 0. Each curve segment emits the places it covers, in
    whole-number arithmetic, so there is no range join.
    """
    last = points - 1
    counts = curve_counts(df, label, score, by).filter((F.col("pos_all") > 0) & (F.col("neg_all") > 0))

    def first_place(false_positives: Column) -> Column:
        # ceil(last * false_positives / neg_all) in whole numbers
        raised = false_positives * last + F.col("neg_all") - 1
        return ((raised - raised % F.col("neg_all")) / F.col("neg_all")).cast("int")

    start = first_place(F.col("fp") - F.col("neg"))
    stop = first_place(F.col("fp")) - 1
    segments = counts.filter((F.col("neg") > 0) & (start <= stop))
    offset = F.col("grid") / last * F.col("neg_all") - (F.col("fp") - F.col("neg"))
    tpr = (F.col("tp") - F.col("pos") + F.col("pos") * offset / F.col("neg")) / F.col("pos_all")
    inner = segments.select("*", F.explode(F.sequence(start, stop)).alias("grid")).select(
        *by,
        "grid",
        (F.col("grid") / last).alias("fpr"),
        F.when(F.col("grid") == 0, 0.0).otherwise(tpr).alias("tpr"),
    )
    # The lowest score closes the curve at (1, 1).
    end = counts.filter((F.col("tp") == F.col("pos_all")) & (F.col("fp") == F.col("neg_all"))).select(
        *by, F.lit(last).alias("grid"), F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr")
    )
    return inner.unionByName(end)


def roc_mean(grid: DataFrame, points: int = 100) -> DataFrame:
    """``(grid, fpr, mean_tpr, std_tpr, lower, upper)`` over the folds of a ``roc_grid``.

    The last mean is set to 1; std is that of the population; the band is kept in [0, 1].
    """
    last = points - 1
    mean = F.when(F.col("grid") == last, 1.0).otherwise(F.col("_mean"))
    return (
        grid.groupBy("grid", "fpr")
        .agg(F.avg("tpr").alias("_mean"), F.stddev_pop("tpr").alias("std_tpr"))
        .select("grid", "fpr", mean.alias("mean_tpr"), "std_tpr")
        .withColumn("lower", F.greatest(F.col("mean_tpr") - F.col("std_tpr"), F.lit(0.0)))
        .withColumn("upper", F.least(F.col("mean_tpr") + F.col("std_tpr"), F.lit(1.0)))
    )


def roc_mean_area(mean: DataFrame, points: int = 100) -> DataFrame:
    """``(mean_auc)``: trapezoid area under the mean curve of ``roc_mean``."""
    ends = F.col("grid").isin(0, points - 1)
    weight = F.when(ends, 0.5).otherwise(1.0)
    return mean.agg((F.sum(F.col("mean_tpr") * weight) / (points - 1)).alias("mean_auc"))


def fold_area_summary(df: DataFrame, label: str, score: str, fold: str, points: int = 100) -> DataFrame:
    """``(mean_auc, std_auc)``: the area under the mean curve of the folds, and the population
    standard deviation of the folds' own areas."""
    mean = roc_mean_area(roc_mean(roc_grid(df, label, score, [fold], points), points), points)
    areas = curve_areas(df, label, score, [fold], only=["auroc"])
    # Two single rows.
    return mean.crossJoin(areas.agg(F.stddev_pop("auroc").alias("std_auc")))


# --- Class decisions ------------------------------------------------------------


def confusion_matrix(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by, label, prediction, rows)`` with all four cells, absent ones as 0."""
    counts = _confusion(df, label, prediction, by)
    cells = [
        F.struct(
            F.lit(truth).alias("label"), F.lit(guess).alias("prediction"), F.col(name).alias("rows")
        )
        for truth, guess, name in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ]
    return counts.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.*")


def _cell(label: str, prediction: str, truth: int, guess: int) -> Column:
    return (F.col(label) == truth) & (F.col(prediction) == guess)


_CELLS = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}


def _confusion(df: DataFrame, label: str, prediction: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        *[F.count_if(_cell(label, prediction, *c)).alias(n) for n, c in _CELLS.items()]
    )


def _decision_metrics() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(f"_{n}") for n in ("tn", "fp", "fn", "tp"))
    return {
        "acc": _ratio(tn + tp, tn + fp + fn + tp),
        "prec0": _ratio(tn, tn + fn),
        "prec1": _ratio(tp, tp + fp),
        "rec0": _ratio(tn, tn + fp),
        "rec1": _ratio(tp, tp + fn),
        "f1scores": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def binary_metrics(
    df: DataFrame, label: str, prediction: str, score: str, by: Sequence[str] = ()
) -> DataFrame:
    """One row of nine metrics per group.

    The confusion counts ride along with the score counts, so the input is read once.
    """
    cells = {
        f"_{n}": F.when(_cell(label, prediction, *c), 1).otherwise(0) for n, c in _CELLS.items()
    }
    curve = curve_counts(df, label, score, by, **cells)
    areas = _area_terms()
    sums = curve.groupBy(*by).agg(
        *[F.sum(n).alias(n) for n in cells],
        *[areas[n].alias(n) for n in ("auroc", "auprc", "minpse")],
    )
    decided = _decision_metrics()
    order = ("acc", "prec0", "prec1", "rec0", "rec1", "auroc", "auprc", "minpse", "f1scores")
    return sums.select(*by, *[decided.get(n, F.col(n)).alias(n) for n in order])


def classification_report(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """``(by, class, precision, recall, f1, support)`` for 0, 1, macro and weighted average.

    A class that is never predicted or never true scores 0, as usual in this report.
    """
    counts = _confusion(df, label, prediction, by)
    tn, fp, fn, tp = (F.col(n) for n in ("tn", "fp", "fn", "tp"))
    zero = F.lit(0.0)

    def scores(right: Column, false_alarms: Column, misses: Column) -> list[Column]:
        return [
            F.coalesce(_ratio(right, right + false_alarms), zero),
            F.coalesce(_ratio(right, right + misses), zero),
            F.coalesce(_ratio(2 * right, 2 * right + false_alarms + misses), zero),
        ]

    zeros, ones = scores(tn, fn, fp), scores(tp, fp, fn)
    n0, n1 = tn + fp, tp + fn
    total = n0 + n1
    macro = [(a + b) / 2 for a, b in zip(zeros, ones)]
    weighted = [F.try_divide(a * n0 + b * n1, total) for a, b in zip(zeros, ones)]
    names = ("precision", "recall", "f1")
    rows = [
        F.struct(
            F.lit(name).alias("class"),
            *[v.alias(n) for n, v in zip(names, values)],
            support.cast("long").alias("support"),
        )
        for name, values, support in (
            ("0", zeros, n0), ("1", ones, n1), ("macro avg", macro, total), ("weighted avg", weighted, total),
        )
    ]
    return counts.select(*by, F.explode(F.array(*rows)).alias("_r")).select(*by, "_r.*")


def cohen_kappa(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by, kappa)``: agreement beyond chance."""
    tn, fp, fn, tp = (F.col(n).cast("double") for n in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    chance = ((tn + fp) * (tn + fn) + (tp + fn) * (tp + fp)) / (total * total)
    observed = (tn + tp) / total
    kappa = F.try_divide(observed - chance, 1 - chance)
    return _confusion(df, label, prediction, by).select(*by, kappa.alias("kappa"))


def soft_fbeta(
    df: DataFrame,
    label: str,
    score: str,
    beta: float = 1.0,
    epsilon: float = 1e-7,
    by: Sequence[str] = (),
) -> DataFrame:
    """``(by, precision, recall, fbeta)`` from scores clipped to [0, 1] and rounded.

    Halves round to even. ``epsilon`` keeps the denominators above zero. Without
    positive labels fbeta is 0.
    """
    if beta < 0:
        raise ValueError("beta must not be negative")

    def clipped(c: Column) -> Column:
        return F.rint(F.greatest(F.least(c.cast("double"), F.lit(1.0)), F.lit(0.0)))

    y, p = F.col(label), F.col(score)
    sums = df.groupBy(*by).agg(
        F.sum(clipped(y * p)).alias("_tp"),
        F.sum(clipped(p)).alias("_predicted"),
        F.sum(clipped(y)).alias("_positive"),
    )
    bb = float(beta) ** 2
    precision, recall = F.col("precision"), F.col("recall")
    return (
        sums.withColumn("precision", F.col("_tp") / (F.col("_predicted") + epsilon))
        .withColumn("recall", F.col("_tp") / (F.col("_positive") + epsilon))
        .select(
            *by,
            "precision",
            "recall",
            F.when(F.col("_positive") == 0, 0.0)
            .otherwise((1 + bb) * precision * recall / (bb * precision + recall + epsilon))
            .alias("fbeta"),
        )
    )


def weighted_log_loss(
    df: DataFrame,
    label: str,
    score: str,
    weight: float = 1.0,
    epsilon: float = 1e-7,
    by: Sequence[str] = (),
) -> DataFrame:
    """``(by, log_loss)``: mean cross-entropy with the positive term times ``weight``.

    Labels and scores are clipped below at ``epsilon``; scores also stay below 1 by it,
    so that a certain wrong score has a finite loss.
    """
    y = F.greatest(F.least(F.col(label).cast("double"), F.lit(1.0)), F.lit(epsilon))
    p = F.greatest(F.least(F.col(score).cast("double"), F.lit(1 - epsilon)), F.lit(epsilon))
    loss = -(y * F.log(p) * weight + (1 - y) * F.log(1 - p))
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def round_to_class(c: Column) -> Column:
    """The nearest class of a score; halves round to even."""
    return F.rint(c).cast("int")
