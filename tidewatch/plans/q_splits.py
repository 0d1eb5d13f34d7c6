"""Queries for the splits (W7-W10, A17) on the cleaned readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import splits
from tidewatch.plans import baseline
from tidewatch.plans.catalogue import register
from tidewatch.plans.oracle import statement

ORDER = ["date", "reading_id"]


def _clean(spark, sf):
    return baseline.fixture_clean(spark, sf).select("reading_id", "date", "year", "flood_event")


@register("q_chrono_split", statement("""
SELECT reading_id, pos >= CAST(floor(0.8 * n) AS BIGINT) AS is_test FROM sp_rank""", "sp_rank"))
def q_chrono_split(spark, sf):
    """First 80 % of rows in (date, sequence) order train, the rest test."""
    return splits.chrono_split(_clean(spark, sf), ORDER, 0.2).select("reading_id", "is_test")


@register("q_time_folds", statement("""
SELECT reading_id, CAST(CASE WHEN pos < n - k * ts THEN 0 ELSE (pos - (n - k * ts)) // ts + 1 END AS INTEGER) AS block,
       CAST(k AS INTEGER) AS folds
FROM (SELECT *, n // (k + 1) AS ts FROM (SELECT *, least(4, greatest(2, n // 200)) AS k FROM fold_rows))""",
    "fold_rows"))
def q_time_folds(spark, sf):
    """Expanding time folds over the rows before the holdout year."""
    df = _clean(spark, sf)
    years = splits.distinct_years(df)
    hold = 2024 if 2024 in years else years[-1]
    k, out = splits.time_folds(df.where(F.col("year") < hold), ORDER, 4)
    return out.select("reading_id", "block", F.lit(k).cast("int").alias("folds"))


@register("q_year_holdout", statement("""
SELECT reading_id, CASE WHEN year < hy THEN 'train' WHEN year = hy THEN 'test' END AS split
FROM clean, holdout_year""", "clean", "holdout_year"))
def q_year_holdout(spark, sf):
    """Train before the holdout year (2024 if present, else the last), test on it."""
    _, out = splits.year_holdout(_clean(spark, sf), ORDER)
    return out.select("reading_id", "split")


@register("q_distinct_years", statement("SELECT DISTINCT year FROM clean WHERE year IS NOT NULL", "clean"))
def q_distinct_years(spark, sf):
    """Distinct years present after cleaning."""
    return _clean(spark, sf).select("year").where(F.col("year").isNotNull()).distinct()


@register("q_stratified_split", statement("""
SELECT c.reading_id, c.flood_event AS label,
       row_number() OVER (PARTITION BY c.flood_event ORDER BY
         substr(md5(concat('42', CAST(c.reading_id AS VARCHAR))), 1, 13), c.reading_id) <= a.tc AS is_test
FROM clean c JOIN strat_alloc a ON c.flood_event = a.label""", "clean", "strat_alloc"))
def q_stratified_split(spark, sf):
    """Per class, the 20 % share with the smallest seeded hash is test."""
    out = splits.stratified_split(_clean(spark, sf), "flood_event", "reading_id", 0.2, 42)
    return out.select("reading_id", F.col("flood_event").alias("label"), "is_test")
