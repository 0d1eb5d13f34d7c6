"""Queries for the metric operators (M4-M7, A6, A16) on score / label pairs from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import metrics
from tidewatch.plans.catalogue import register, round_doubles
from tidewatch.plans.oracle import cte, statement
from tidewatch.sources import fixture

cte("m_cells", ["pairs"], """
  SELECT fold, CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS BIGINT) AS tn,
         CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS BIGINT) AS fp,
         CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS BIGINT) AS fn,
         CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS BIGINT) AS tp
  FROM pairs GROUP BY fold""")


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


_SUMMARY = {
    "accuracy": _div("tp + tn", "tn + fp + fn + tp"),
    "precision": _div("tp", "tp + fp"),
    "recall": _div("tp", "tp + fn"),
    "f1": _div("2 * tp", "2 * tp + fp + fn"),
    "balanced_accuracy": f"(({_div('tp', 'tp + fn')}) * CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END + "
                         f"({_div('tn', 'tn + fp')}) * CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END) / "
                         "greatest(CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END + CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END, 1)",
}


def auc_cte(name: str, src: str, score: str = "score", deps=("pairs",)) -> None:
    cte(name, list(deps), f"""
  SELECT fold, CASE WHEN sum(np) = 0 OR sum(nn) = 0 THEN CAST(0 AS DOUBLE)
              ELSE CAST(sum(CAST(np AS HUGEINT) * (2 * below + nn)) AS DOUBLE)
                   / (CAST(2 AS DOUBLE) * CAST(sum(np) AS DOUBLE) * CAST(sum(nn) AS DOUBLE)) END AS roc_auc
  FROM (SELECT *, coalesce(sum(nn) OVER (PARTITION BY fold ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT fold, {score} AS s, count(*) FILTER (WHERE label = 1) AS np, count(*) FILTER (WHERE label <> 1) AS nn
              FROM {src} WHERE {score} IS NOT NULL GROUP BY fold, {score}))
  GROUP BY fold""")


auc_cte("m_auc", "pairs")
cte("m_eval", ["m_cells", "m_auc"], "SELECT c.*, " + ", ".join(f"{v} AS {k}" for k, v in _SUMMARY.items())
    + ", a.roc_auc FROM m_cells c JOIN m_auc a USING (fold)")


def _pairs(spark, sf):
    return fixture.score_labels(spark, sf)


@register("q_confusion", statement("SELECT fold, tn, fp, fn, tp FROM m_cells", "m_cells"))
def q_confusion(spark, sf):
    """M5: confusion cells per fold."""
    return metrics.confusion(_pairs(spark, sf), groups=["fold"])


@register("q_class_report", statement(f"""
SELECT fold, 1 AS class, round({_div('tp', 'tp + fp')}, 6) AS precision, round({_div('tp', 'tp + fn')}, 6) AS recall,
       round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1, tp + fn AS support FROM m_cells
UNION ALL
SELECT fold, 0, round({_div('tn', 'tn + fn')}, 6), round({_div('tn', 'tn + fp')}, 6),
       round({_div('2 * tn', '2 * tn + fn + fp')}, 6), tn + fp FROM m_cells""", "m_cells"))
def q_class_report(spark, sf):
    """M5: per-class precision, recall, f1 and support per fold."""
    cells = metrics.confusion(_pairs(spark, sf), groups=["fold"])
    return round_doubles(metrics.class_report(cells, ["fold"]))


@register("q_exact_auc", statement("SELECT fold, round(roc_auc, 6) AS roc_auc FROM m_auc", "m_auc"))
def q_exact_auc(spark, sf):
    """M5: exact ROC AUC per fold (tied scores count one half)."""
    return round_doubles(metrics.exact_auc(_pairs(spark, sf), groups=["fold"]))


@register("q_balanced_accuracy", statement(
    "SELECT fold, " + ", ".join(f"round({k}, 6) AS {k}" for k in _SUMMARY) + " FROM m_eval", "m_eval"))
def q_balanced_accuracy(spark, sf):
    """M5 + M6: accuracy, precision, recall, f1 and balanced accuracy per fold."""
    cells = metrics.confusion(_pairs(spark, sf), groups=["fold"]).withColumns(metrics.summary_columns())
    return round_doubles(cells.select("fold", *metrics.summary_columns().keys()))


@register("q_fold_average", statement("""
SELECT round(avg(accuracy), 6) AS accuracy, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(f1), 6) AS f1, round(avg(roc_auc), 6) AS roc_auc,
       CAST(round_even(avg(tn), 0) AS BIGINT) AS tn, CAST(round_even(avg(fp), 0) AS BIGINT) AS fp,
       CAST(round_even(avg(fn), 0) AS BIGINT) AS fn, CAST(round_even(avg(tp), 0) AS BIGINT) AS tp
FROM m_eval""", "m_eval"))
def q_fold_average(spark, sf):
    """Fold metrics averaged, confusion cells rounded half-to-even."""
    return round_doubles(metrics.fold_average(metrics.evaluate(_pairs(spark, sf), groups=["fold"])))


cte("m_pairs2", ["pairs"], """
  SELECT 'value_score' AS model, 0 AS position, fold, score, label, prediction FROM pairs
  UNION ALL
  SELECT 'inverse_score', 1, fold, 1 - score, label, CASE WHEN 1 - score >= 0.9 THEN 1 ELSE 0 END FROM pairs""")


cte("mc_cells", ["m_pairs2"], """
  SELECT model, position, fold < 3 AS cv, fold,
         count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn
  FROM m_pairs2 GROUP BY ALL""")
cte("mc_auc", ["m_pairs2"], """
  SELECT model, fold, CASE WHEN sum(np) = 0 OR sum(nn) = 0 THEN CAST(0 AS DOUBLE)
              ELSE CAST(sum(CAST(np AS HUGEINT) * (2 * below + nn)) AS DOUBLE)
                   / (CAST(2 AS DOUBLE) * CAST(sum(np) AS DOUBLE) * CAST(sum(nn) AS DOUBLE)) END AS roc_auc
  FROM (SELECT *, coalesce(sum(nn) OVER (PARTITION BY model, fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT model, fold, score, count(*) FILTER (WHERE label = 1) AS np, count(*) FILTER (WHERE label <> 1) AS nn
              FROM m_pairs2 GROUP BY model, fold, score)) GROUP BY model, fold""")
cte("mc_card", ["mc_cells", "mc_auc"], """
  SELECT model, position,
         max(recall) FILTER (WHERE NOT cv) AS holdout_recall, max(roc_auc) FILTER (WHERE NOT cv) AS holdout_auc,
         avg(recall) FILTER (WHERE cv) AS folds_recall, avg(roc_auc) FILTER (WHERE cv) AS folds_auc
  FROM (SELECT c.*, CASE WHEN tp + fn = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall,
               a.roc_auc FROM mc_cells c JOIN mc_auc a USING (model, fold))
  GROUP BY model, position""")


@register("q_choose_model", statement("""
SELECT model, round(0.6 * holdout_recall + 0.3 * holdout_auc + 0.2 * folds_recall + 0.1 * folds_auc, 6) AS choice_score
FROM mc_card ORDER BY 0.6 * holdout_recall + 0.3 * holdout_auc + 0.2 * folds_recall + 0.1 * folds_auc DESC, position LIMIT 1""",
    "mc_card"))
def q_choose_model(spark, sf):
    """M7 (+ M12 scorecard shape): holdout = fold 3, cross-validation = folds 0-2, two candidates."""
    p = _pairs(spark, sf)
    cands = [("value_score", 0, p),
             ("inverse_score", 1, p.withColumns({"score": 1 - F.col("score"),
                                                  "prediction": F.when(1 - F.col("score") >= 0.9, 1).otherwise(0)}))]
    cards = None
    for name, pos, df in cands:
        per = metrics.evaluate(df, groups=["fold"])
        hold = per.where(F.col("fold") == 3).select(F.col("recall").alias("holdout_recall"),
                                                    F.col("roc_auc").alias("holdout_auc"))
        cv = metrics.fold_average(per.where(F.col("fold") < 3)).select(
            F.col("recall").alias("folds_recall"), F.col("roc_auc").alias("folds_auc"))
        card = hold.crossJoin(cv).select(F.lit(name).alias("model"), F.lit(pos).alias("position"), "*")
        cards = card if cards is None else cards.unionByName(card)
    best = metrics.choose_model(cards)
    return round_doubles(best.select("model", "choice_score"))


@register("q_class_weights", statement("""
SELECT p.row_id, p.label, round(CAST(t.n AS DOUBLE) / CAST(t.k * c.nc AS DOUBLE), 6) AS weight
FROM pairs p JOIN (SELECT label, count(*) AS nc FROM pairs GROUP BY label) c USING (label)
CROSS JOIN (SELECT count(*) AS n, count(DISTINCT label) AS k FROM pairs) t""", "pairs"))
def q_class_weights(spark, sf):
    """M4: balanced class weights n / (k * n_c) per row."""
    return round_doubles(metrics.class_weights(_pairs(spark, sf)).select("row_id", "label", "weight"))


@register("q_score_summary", statement(
    "SELECT round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS mean FROM pairs",
    "pairs"))
def q_score_summary(spark, sf):
    """Min / max / mean of the scores."""
    return round_doubles(metrics.score_summary(_pairs(spark, sf)))
