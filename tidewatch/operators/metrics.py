"""Classification metrics and model choice.

Everything starts from one count table: ``groupBy(groups, label, prediction)``
for the confusion cells and ``groupBy(groups, score)`` with positive / negative
counts for the exact ROC AUC.  Both are map-side combined aggregates, so a hot
group never sends its raw rows to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed
from tidewatch.operators import timeseries
from tidewatch.session import cut_lineage


def _safe_div(num: Column, den: Column) -> Column:
    """num / den, 0 when the denominator is 0 (zero_division = 0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction",
              groups: list[str] = ()) -> DataFrame:
    """Confusion cells tn, fp, fn, tp (BIGINT) per group."""
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*groups).agg(
        F.count_if((y == 0) & (p == 0)).cast("long").alias("tn"),
        F.count_if((y == 0) & (p == 1)).cast("long").alias("fp"),
        F.count_if((y == 1) & (p == 0)).cast("long").alias("fn"),
        F.count_if((y == 1) & (p == 1)).cast("long").alias("tp"))


def summary_columns() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    return {
        "accuracy": _safe_div(tp + tn, n),
        "precision": _safe_div(tp, tp + fp),
        "recall": _safe_div(tp, tp + fn),
        "f1": _safe_div(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": (_safe_div(tp, tp + fn) * F.when(tp + fn > 0, 1).otherwise(0)
                              + _safe_div(tn, tn + fp) * F.when(tn + fp > 0, 1).otherwise(0))
        / F.greatest(F.when(tp + fn > 0, 1).otherwise(0) + F.when(tn + fp > 0, 1).otherwise(0), F.lit(1)),
    }


def class_report(cells: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Per class: precision, recall, f1, support (from the confusion cells)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    pos = cells.select(*groups, F.lit(1).alias("class"), _safe_div(tp, tp + fp).alias("precision"),
                       _safe_div(tp, tp + fn).alias("recall"), _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
                       (tp + fn).alias("support"))
    neg = cells.select(*groups, F.lit(0).alias("class"), _safe_div(tn, tn + fn).alias("precision"),
                       _safe_div(tn, tn + fp).alias("recall"), _safe_div(2 * tn, 2 * tn + fn + fp).alias("f1"),
                       (tn + fp).alias("support"))
    return pos.unionByName(neg)


def exact_auc(df: DataFrame, label: str = "label", score: str = "score", groups: list[str] = ()) -> DataFrame:
    """Exact ROC AUC per group (ties count one half); 0.0 when a group has one class.

    Per distinct score: positives ``np`` and negatives ``nn``.  Negatives below a
    score come from an ordered scan of the distinct scores over range partitions,
    so clustered scores spread like any others.  The numerator
    sum(np * (2 below + nn)) is an exact integer.
    """
    g = list(groups)
    y = F.col(label)
    per_score = cut_lineage(df.where(F.col(score).isNotNull()).groupBy(*g, score).agg(
        F.count_if(y == 1).cast("long").alias("np"), F.count_if(y != 1).cast("long").alias("nn")), "score-counts")
    b = timeseries.ordered_scan(per_score, g, [score], sums=[("nn", [], "_upto")], skip_null_keys=False)
    below = F.col("_upto") - F.col("nn")
    b = b.withColumn("_num", (F.col("np").cast("decimal(38,0)") * (below * 2 + F.col("nn")).cast("decimal(38,0)")))
    agg = b.groupBy(*g).agg(F.sum("_num").alias("_num"), F.sum("np").alias("_p"), F.sum("nn").alias("_n"))
    auc = F.when((F.col("_p") == 0) | (F.col("_n") == 0), F.lit(0.0)).otherwise(
        F.col("_num").cast("double") / (F.lit(2.0) * F.col("_p").cast("double") * F.col("_n").cast("double")))
    return agg.select(*g, auc.alias("roc_auc"))


def evaluate(df: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "score",
             groups: list[str] = ()) -> DataFrame:
    """M5 + M6: cells, accuracy, precision, recall, f1, balanced accuracy and ROC AUC per group."""
    cells = confusion(df, label, prediction, groups).withColumns(summary_columns())
    auc = exact_auc(df, label, score, groups)
    return cells.join(auc, list(groups), "left") if groups else cells.crossJoin(auc)


def fold_average(per_fold: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Mean of fold metrics; confusion cells averaged then rounded half-to-even."""
    metrics = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    return per_fold.groupBy(*groups).agg(
        *[F.avg(m).alias(m) for m in metrics],
        *[F.rint(F.avg(c)).cast("long").alias(c) for c in ("tn", "fp", "fn", "tp")])


def choice_score(holdout_recall, holdout_auc, folds_recall, folds_auc) -> Column:
    """M7: 0.60 / 0.30 / 0.20 / 0.10 weighted blend of holdout and fold recall and AUC."""
    w = fixed.CHOICE_WEIGHTS
    return (F.lit(w["holdout_recall"]) * holdout_recall + F.lit(w["holdout_auc"]) * holdout_auc
            + F.lit(w["folds_recall"]) * folds_recall + F.lit(w["folds_auc"]) * folds_auc)


def choose_model(scorecard: DataFrame) -> DataFrame:
    """M7: the best candidate by the blend; ties keep the earlier ``position`` (top-1 report)."""
    scored = scorecard.withColumn("choice_score", choice_score(
        F.col("holdout_recall"), F.col("holdout_auc"), F.col("folds_recall"), F.col("folds_auc")))
    return scored.orderBy(F.col("choice_score").desc(), F.col("position")).limit(1)


def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """M4: balanced weight n / (k * n_c) per row (one small per-class table, broadcast)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    totals = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(totals).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out))
    return df.join(w, label, "left")  # one row per class


def score_summary(df: DataFrame, score: str = "score") -> DataFrame:
    """Min / max / mean of scores."""
    return df.agg(F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("mean"))
