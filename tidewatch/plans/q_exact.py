"""Queries that reach the special cases of the exact operators: infinities, NaN, null keys, wide ids, skew."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import learn, metrics, quantiles, splits, timeseries
from tidewatch.plans.catalogue import register, round_doubles
from tidewatch.plans.oracle import cte, statement
from tidewatch.plans.q_metrics import auc_cte
from tidewatch.sources.tables import load_table

_SHARES = {"q01": 0.01, "q50": 0.5, "q90": 0.9, "q995": 0.995}


def _lerp_sql(name: str, p: float) -> str:
    lo, hi = (f"max(x) FILTER (k = {f}({p} * (n - 1)))" for f in ("floor", "ceil"))
    t = f"max({p} * (n - 1) - floor({p} * (n - 1)))"
    inf = "CAST('infinity' AS DOUBLE)"
    return (f"CASE WHEN {lo} = {hi} OR {t} = 0 OR {lo} = -{inf} THEN {lo} WHEN {hi} = {inf} THEN {hi} "
            f"WHEN {t} >= 0.5 THEN {hi} - ({hi} - {lo}) * (1 - {t}) ELSE {lo} + ({hi} - {lo}) * {t} END AS {name}")


@register("q_quantile_special", f"""
WITH v AS (SELECT CASE WHEN event_id % 11 > 0 THEN user_id % 3 END AS g,
                  CASE WHEN event_id % 97 = 0 THEN CAST('infinity' AS DOUBLE) WHEN event_id % 89 = 0 THEN CAST('-infinity' AS DOUBLE)
                       WHEN event_id % 83 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 79 = 0 THEN NULL ELSE value END AS x FROM events),
r AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY g) AS n
      FROM v WHERE g IS NOT NULL AND x IS NOT NULL AND NOT isnan(x))
SELECT CAST(g AS BIGINT) AS g, {", ".join(_lerp_sql(n, p) for n, p in _SHARES.items())} FROM r GROUP BY g""")
def q_quantile_special(spark, sf):
    """A3 with infinities, NaN, nulls and null group keys."""
    e, i = load_table(spark, sf, "events", ["event_id", "user_id", "value"]), F.col("event_id")
    x = F.when(i % 97 == 0, float("inf")).when(i % 89 == 0, float("-inf")).when(i % 83 == 0, float("nan")) \
        .when(i % 79 == 0, F.lit(None)).otherwise(F.col("value"))
    v = e.select(F.when(i % 11 > 0, F.col("user_id") % 3).cast("long").alias("g"), x.alias("x"))
    return quantiles.quantile_table(v, {n: ("x", p) for n, p in _SHARES.items()}, ["g"])


@register("q_chrono_split_bigid", """
SELECT id, row_number() OVER (ORDER BY d, id) - 1 >= CAST(floor(0.8 * count(*) OVER ()) AS BIGINT) AS is_test
FROM (SELECT event_id * 1099511627776 + event_id % 7 AS id, CAST(ts AS DATE) AS d FROM events)""")
def q_chrono_split_bigid(spark, sf):
    """W7 with ids beyond the whole numbers a double holds."""
    e = load_table(spark, sf, "events", ["event_id", "ts"])
    rows = e.select((F.col("event_id") * F.lit(2 ** 40) + F.col("event_id") % 7).alias("id"), F.to_date("ts").alias("d"))
    return splits.chrono_split(rows, ["d", "id"], 0.2).select("id", "is_test")


@register("q_running_sum_nulls", """
SELECT event_id, round(sum(v) OVER w, 6) AS total, lag(v) OVER w AS v_lag1
FROM (SELECT event_id, user_id % 3 AS k, CASE WHEN event_id % 2 = 0 OR user_id % 4 = 0 OR event_id < 300 THEN NULL ELSE value END AS v FROM events)
WINDOW w AS (PARTITION BY k ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def q_running_sum_nulls(spark, sf):
    """W1 + W2 over values that are often null, keys of a third of the rows each."""
    i = F.col("event_id")
    e = load_table(spark, sf, "events", ["event_id", "user_id", "value"]).select(
        "event_id", (F.col("user_id") % 3).alias("k"),
        F.when((i % 2 == 0) | (F.col("user_id") % 4 == 0) | (i < 300), F.lit(None).cast("double")).otherwise(F.col("value")).alias("v"))
    out = timeseries.ordered_scan(e, ["k"], ["event_id"], ["v"], [("v", [], "total")])
    return out.select("event_id", F.round("total", 6).alias("total"), "v_lag1")


cte("skew_pairs", ["pairs"], "SELECT fold, label, CASE WHEN row_id = 1 THEN 1000000 ELSE round(score, 3) END AS score FROM pairs")
auc_cte("skew_auc", "skew_pairs", deps=("skew_pairs",))


@register("q_auc_skewed", statement("SELECT fold, round(roc_auc, 6) AS roc_auc FROM skew_auc", "skew_auc"))
def q_auc_skewed(spark, sf):
    """M5: exact ROC AUC where all scores but one lie close together and many are tied."""
    from tidewatch.sources import fixture

    p = fixture.score_labels(spark, sf).withColumn("score", F.when(F.col("row_id") == 1, F.lit(1e6)).otherwise(F.round("score", 3)))
    return round_doubles(metrics.exact_auc(p, groups=["fold"]))


@register("q_permuted_column", """
WITH x AS (SELECT event_id, r AS repeat, value, md5(concat('42:', r, ':value:', event_id)) AS h
           FROM events, (VALUES (0), (1), (2)) t(r))
SELECT event_id, CAST(repeat AS INTEGER) AS repeat,
       CASE WHEN row_number() OVER w = 1 THEN last_value(value) OVER (PARTITION BY repeat ORDER BY h, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE lag(value) OVER w END AS value
FROM x WINDOW w AS (PARTITION BY repeat ORDER BY h, event_id)""")
def q_permuted_column(spark, sf):
    """M9: three seeded permutations of a column."""
    e = load_table(spark, sf, "events", ["event_id", "value"])
    return learn.permuted(e, "value", 3, id_col="event_id").select("event_id", F.col("_repeat").alias("repeat"), "value")
