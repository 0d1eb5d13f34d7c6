"""Queries for the audit tables (A7-A10, A17, C9 data-quality block, C11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidewatch.operators import audit
from tidewatch.plans import baseline, clean
from tidewatch.plans.catalogue import register, round_doubles
from tidewatch.plans.oracle import FAULTY_DISTRICT, SURGE_DISTRICTS, cte, statement
from tidewatch.sources import fixture

CORR_COLS = ["elevation", "evaporation", "latitude", "longitude", "precipitation", "pressure", "soil_moisture",
             "temperature", "water_area_km2", "wind_speed", "humidity", "precip_3day_avg", "precip_7day_avg",
             "temp_3day_avg", "soil_3day_avg", "day_of_year", "month", "year", "is_monsoon", "water_area_change",
             "water_area_pct_change", "ds_idx", "rain_soil_interaction", "monsoon_cumulative_precip",
             "water_area_km2_lag1", "water_area_change_lag1", "water_area_pct_change_lag1", "avg_elevation_m"]

cte("corr_wide", ["model"], "SELECT " + ", ".join(
    f"CASE WHEN min(CASE WHEN flood_event IS NOT NULL THEN CAST({c} AS DOUBLE) END) = "
    f"max(CASE WHEN flood_event IS NOT NULL THEN CAST({c} AS DOUBLE) END) THEN NULL "
    f"ELSE abs(corr(CAST({c} AS DOUBLE), CAST(flood_event AS DOUBLE))) END AS {c}" for c in CORR_COLS) + " FROM model")


@register("q_target_correlation", statement("""
SELECT feature, round(abs_corr, 6) AS abs_corr FROM (UNPIVOT corr_wide ON COLUMNS(*) INTO NAME feature VALUE abs_corr)
ORDER BY abs_corr IS NULL, abs_corr DESC, feature LIMIT 12""", "corr_wide"))
def q_target_correlation(spark, sf):
    """The 12 numeric columns most correlated (absolute Pearson r) with the label."""
    df = baseline.fixture_model_frame(spark, sf)
    out = audit.target_correlations(df, "flood_event", exclude=["reading_id", "station"])
    return round_doubles(out)


@register("q_duplicate_keys", statement("""
SELECT CAST(count(*) - count(DISTINCT (district, date)) AS BIGINT) AS duplicate_keys FROM clean""", "clean"))
def q_duplicate_keys(spark, sf):
    """Rows repeating an earlier (district, date) after cleaning."""
    return audit.duplicate_keys(baseline.fixture_clean(spark, sf), ["district", "date"])


@register("q_label_rate", statement("SELECT round(avg(CAST(flood_event AS DOUBLE)), 6) AS label_rate FROM model",
                                    "model"))
def q_label_rate(spark, sf):
    """Share of flood rows in the model frame."""
    return round_doubles(audit.label_rate(baseline.fixture_model_frame(spark, sf)))


@register("q_crosstab", statement("""
SELECT ds_idx, CAST(count(*) FILTER (WHERE flood_event = 0) AS BIGINT) AS flood_event_0,
       CAST(count(*) FILTER (WHERE flood_event = 1) AS BIGINT) AS flood_event_1
FROM raw WHERE ds_idx IS NOT NULL AND flood_event IS NOT NULL GROUP BY ds_idx""", "raw"))
def q_crosstab(spark, sf):
    """A10 / C11: index column against the label on the raw table."""
    return audit.crosstab(fixture.readings(spark, sf), "ds_idx", "flood_event")


@register("q_crosstab_long", statement("""
SELECT a.ds_idx, b.flood_event, CAST(count(raw.reading_id) AS BIGINT) AS n
FROM (SELECT DISTINCT ds_idx FROM raw WHERE ds_idx IS NOT NULL AND flood_event IS NOT NULL) a
CROSS JOIN (SELECT DISTINCT flood_event FROM raw WHERE ds_idx IS NOT NULL AND flood_event IS NOT NULL) b
LEFT JOIN raw ON raw.ds_idx = a.ds_idx AND raw.flood_event = b.flood_event GROUP BY ALL""", "raw"))
def q_crosstab_long(spark, sf):
    """A10 / C11 in long form: every cell, zeros included."""
    return audit.crosstab_long(fixture.readings(spark, sf), "ds_idx", "flood_event")


_SAMPLE_COLS = ["water_area_km2", "water_area_change", "water_area_pct_change", "ds_idx"]


@register("q_distinct_sample", statement(" UNION ALL ".join(
    f"(SELECT '{c}' AS column, CAST(v AS DOUBLE) AS value, first_seen FROM ("
    f"SELECT {c} AS v, min(reading_id) AS first_seen FROM raw WHERE {c} IS NOT NULL GROUP BY {c}) "
    f"ORDER BY first_seen, v LIMIT 5)" for c in _SAMPLE_COLS), "raw"))
def q_distinct_sample(spark, sf):
    """First five distinct values of each leakage-prone column in row order."""
    raw = fixture.readings(spark, sf)
    parts = [audit.first_distinct(raw, c, "reading_id", 5) for c in _SAMPLE_COLS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("q_leakage_summary", statement("""
SELECT q.*, k.duplicate_keys AS duplicate_district_date_after_cleanup, r.label_rate AS flood_event_rate
FROM (SELECT CAST(count(*) AS BIGINT) AS rows_before,
       CAST((SELECT count(*) FROM dedup) AS BIGINT) AS rows_after,
       CAST(count(*) FILTER (WHERE date_ok AND NOT phantom) - (SELECT count(*) FROM dedup) AS BIGINT) AS duplicates_removed,
       CAST(count(*) FILTER (WHERE date_ok AND phantom) AS BIGINT) AS phantom_rows_removed,
       CAST(count(*) FILTER (WHERE NOT date_ok) AS BIGINT) AS bad_date_rows_removed,
       CAST(count(*) FILTER (WHERE date_ok AND precipitation IS NULL) AS BIGINT) AS precipitation_missing_count,
       CAST(count(*) FILTER (WHERE date_ok AND water_area_pct_change IS NULL) AS BIGINT) AS water_pct_non_finite_count
      FROM staged) q,
     (SELECT CAST(count(*) - count(DISTINCT (district, date)) AS BIGINT) AS duplicate_keys FROM clean) k,
     (SELECT round(avg(CAST(flood_event AS DOUBLE)), 6) AS label_rate FROM model) r""",
    "staged", "dedup", "clean", "model"))
def q_leakage_summary(spark, sf):
    """C9 data-quality block: cleaning counters, duplicate keys after cleaning, label rate."""
    return _leakage_summary(fixture.readings(spark, sf), baseline.fixture_clean(spark, sf),
                            baseline.fixture_model_frame(spark, sf))


def _leakage_summary(raw, cleaned, model_df):
    out = clean.quality_counters(raw).crossJoin(
        audit.duplicate_keys(cleaned, ["district", "date"]).select(
            F.col("duplicate_keys").alias("duplicate_district_date_after_cleanup"))).crossJoin(
        audit.label_rate(model_df).select(F.col("label_rate").alias("flood_event_rate")))
    return round_doubles(out)


@register("q_leakage_summary_scenarios")
def q_leakage_summary_scenarios(spark, sf):
    """C9 data-quality block as the source runs it: after C4 and C3."""
    edits = (FAULTY_DISTRICT, SURGE_DISTRICTS)
    return _leakage_summary(baseline.fixture_audit_raw(spark, sf, *edits), baseline.fixture_audit_clean(spark, sf, *edits),
                            baseline.fixture_audit_frame(spark, sf, *edits))


@register("q_target_correlation_scenarios")
def q_target_correlation_scenarios(spark, sf):
    """A9 in C9 as the source runs it: after C4 and C3."""
    df = baseline.fixture_audit_frame(spark, sf, FAULTY_DISTRICT, SURGE_DISTRICTS)
    return round_doubles(audit.target_correlations(df, "flood_event", exclude=["reading_id", "station"]))
