"""Queries for the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import rules
from tidewatch.operators import quality, quantiles
from tidewatch.plans import baseline, clean
from tidewatch.plans.catalogue import register, round_doubles
from tidewatch.plans.oracle import _num, statement
from tidewatch.sources import fixture

_PARSED = "CAST(try_strptime(date, '%m/%d/%Y') AS DATE)"


@register("q_cast_dates", statement(f"""
SELECT reading_id, {_PARSED} AS date, round({_num('precipitation')}, 6) AS precipitation,
       round({_num('soil_moisture')}, 6) AS soil_moisture
FROM raw WHERE {_PARSED} IS NOT NULL""", "raw"))
def q_cast_dates(spark, sf):
    """P1 + P2: parse dates (bad ones dropped) and coerce text measures."""
    raw = fixture.readings(spark, sf)
    out = quality.drop_bad_dates(raw).select(
        "reading_id", "date", rules.to_number("precipitation").alias("precipitation"),
        rules.to_number("soil_moisture").alias("soil_moisture"))
    return round_doubles(out)


@register("q_sentinel_missing", statement(f"""
SELECT district,
       CAST(count(*) FILTER (WHERE p IS NULL OR p = -999) AS BIGINT) AS missing_rain,
       CAST(count(*) FILTER (WHERE p = -999) AS BIGINT) AS sentinel_rain
FROM (SELECT district, {_num('precipitation')} AS p FROM raw WHERE {_PARSED} IS NOT NULL)
GROUP BY district""", "raw"))
def q_sentinel_missing(spark, sf):
    """Sentinel rain becomes missing; missing and sentinel counts per district."""
    raw = fixture.readings(spark, sf)
    dated = quality.drop_bad_dates(raw)
    coerced = dated.withColumn("_p", rules.to_number("precipitation"))
    out = coerced.withColumn("precipitation", rules.sentinel_to_null("_p"))
    return out.groupBy("district").agg(
        F.count_if(F.col("precipitation").isNull()).cast("long").alias("missing_rain"),
        F.count_if(F.col("_p") == -999.0).cast("long").alias("sentinel_rain"))


@register("q_nonfinite", statement("""
SELECT district,
       CAST(count(*) FILTER (WHERE isinf(TRY_CAST(water_area_pct_change AS DOUBLE))) AS BIGINT) AS infinite_pct,
       CAST(count(*) FILTER (WHERE water_area_pct_change IS NULL OR isinf(TRY_CAST(water_area_pct_change AS DOUBLE))) AS BIGINT) AS missing_pct
FROM raw WHERE CAST(try_strptime(date, '%m/%d/%Y') AS DATE) IS NOT NULL GROUP BY district""", "raw"))
def q_nonfinite(spark, sf):
    """Infinite percentage change becomes missing; counts per district."""
    raw = quality.drop_bad_dates(fixture.readings(spark, sf))
    out = raw.withColumn("_inf", rules.is_infinite("water_area_pct_change"))
    out = quality.null_infinite(out, "water_area_pct_change")
    return out.groupBy("district").agg(
        F.count_if(F.col("_inf")).cast("long").alias("infinite_pct"),
        F.count_if(F.col("water_area_pct_change").isNull()).cast("long").alias("missing_pct"))


@register("q_phantom_filter", statement("""
SELECT reading_id, district, round(soil_moisture, 6) AS soil_moisture, round(humidity, 6) AS humidity,
       round(precipitation, 6) AS precipitation
FROM staged WHERE date_ok AND NOT phantom""", "staged"))
def q_phantom_filter(spark, sf):
    """P5: rows with a value outside its plausible range are removed (nulls pass)."""
    s = clean.staged(fixture.readings(spark, sf))
    kept = s.where(F.col("_date_ok")).drop("_date_ok", "_phantom")
    kept = quality.drop_phantoms(kept)
    return round_doubles(kept.select("reading_id", "district", "soil_moisture", "humidity", "precipitation"))


_DEDUP_COLS = ["reading_id", "station", "district", "date"] + [
    "elevation", "evaporation", "latitude", "longitude", "precipitation", "pressure", "soil_moisture",
    "temperature", "water_area_km2", "wind_speed", "humidity", "precip_3day_avg", "precip_7day_avg",
    "temp_3day_avg", "soil_3day_avg", "day_of_year", "month", "year", "is_monsoon", "water_area_change",
    "water_area_pct_change", "ds_idx", "flood_event"]


@register("q_exact_dedup", statement(
    "SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c not in ("reading_id", "station", "district", "date") else c
                          for c in _DEDUP_COLS) + " FROM dedup", "dedup"))
def q_exact_dedup(spark, sf):
    """Exact duplicate rows removed after the range filter."""
    return round_doubles(clean.filtered(fixture.readings(spark, sf)).select(*_DEDUP_COLS))


@register("q_quality_counters", statement("""
SELECT CAST(count(*) AS BIGINT) AS rows_before,
       CAST((SELECT count(*) FROM dedup) AS BIGINT) AS rows_after,
       CAST(count(*) FILTER (WHERE date_ok AND NOT phantom) - (SELECT count(*) FROM dedup) AS BIGINT) AS duplicates_removed,
       CAST(count(*) FILTER (WHERE date_ok AND phantom) AS BIGINT) AS phantom_rows_removed,
       CAST(count(*) FILTER (WHERE NOT date_ok) AS BIGINT) AS bad_date_rows_removed,
       CAST(count(*) FILTER (WHERE date_ok AND precipitation IS NULL) AS BIGINT) AS precipitation_missing_count,
       CAST(count(*) FILTER (WHERE date_ok AND water_area_pct_change IS NULL) AS BIGINT) AS water_pct_non_finite_count
FROM staged""", "staged", "dedup"))
def q_quality_counters(spark, sf):
    """The seven counters of a cleaning run."""
    return clean.quality_counters(fixture.readings(spark, sf))


@register("q_winsorize", statement("""
SELECT reading_id, round(water_area_pct_change, 6) AS water_area_pct_change, round(lo, 6) AS lo, round(hi, 6) AS hi
FROM wins CROSS JOIN wbounds""", "wins", "wbounds"))
def q_winsorize(spark, sf):
    """P15 + A3: clip to the exact 1 % / 99 % quantiles after cleaning; nulls kept."""
    from tidewatch.operators.timeseries import add_calendar
    df = add_calendar(clean.filtered(fixture.readings(spark, sf)))
    bounds = quantiles.winsor_bounds(df, "water_area_pct_change", 0.01, 0.99)
    out = quantiles.winsorize(df, "water_area_pct_change", 0.01, 0.99).crossJoin(
        F.broadcast(bounds.select(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))))
    return round_doubles(out.select("reading_id", "water_area_pct_change", "lo", "hi"))


@register("q_interaction", statement("""
SELECT reading_id, round(rain_soil_interaction, 6) AS rain_soil_interaction,
       round(CASE WHEN is_monsoon = 1 THEN coalesce(precipitation, 0) ELSE 0 END, 6) AS monsoon_rain
FROM feat""", "feat"))
def q_interaction(spark, sf):
    """P11 + P12: rain x soil (missing as 0) and in-season rain."""
    from tidewatch.operators.timeseries import add_calendar
    df = add_calendar(clean.filtered(fixture.readings(spark, sf)))
    out = df.select("reading_id",
                    rules.rain_soil_interaction("precipitation", "soil_moisture").alias("rain_soil_interaction"),
                    rules.seasonal_rain("is_monsoon", "precipitation").alias("monsoon_rain"))
    return round_doubles(out)


@register("q_running_sum", statement("""
SELECT reading_id, district, year, round(monsoon_cumulative_precip, 6) AS monsoon_cumulative_precip FROM clean""",
                                     "clean"))
def q_running_sum(spark, sf):
    """In-season rain accumulated per (district, year) in date order."""
    out = baseline.fixture_clean(spark, sf)
    return round_doubles(out.select("reading_id", "district", "year", "monsoon_cumulative_precip"))


@register("q_lag_fill", statement("""
SELECT reading_id, round(water_area_km2_lag1, 6) AS water_area_km2_lag1,
       round(water_area_change_lag1, 6) AS water_area_change_lag1,
       round(water_area_pct_change_lag1, 6) AS water_area_pct_change_lag1
FROM clean""", "clean"))
def q_lag_fill(spark, sf):
    """W2 + A4: previous-row water values per district, gaps filled with global medians."""
    out = baseline.fixture_clean(spark, sf)
    return round_doubles(out.select("reading_id", "water_area_km2_lag1", "water_area_change_lag1",
                                    "water_area_pct_change_lag1"))


CLEAN_COLS = _DEDUP_COLS + ["rain_soil_interaction", "monsoon_cumulative_precip", "water_area_km2_lag1",
                            "water_area_change_lag1", "water_area_pct_change_lag1"]


@register("q_clean_features", statement(
    "SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c not in ("reading_id", "station", "district", "date",
                                                               "month", "year", "day_of_year", "is_monsoon")
                          else c for c in CLEAN_COLS) + " FROM clean", "clean"))
def q_clean_features(spark, sf):
    """The whole cleaning and feature job."""
    return round_doubles(clean.clean_readings(fixture.readings(spark, sf)).select(*CLEAN_COLS))


_FRAME_DROP = ["flood_event", "date", "elevation", "latitude", "longitude", "water_area_km2", "water_area_change",
               "water_area_pct_change", "ds_idx"]


@register("q_feature_frame", statement(
    "SELECT * EXCLUDE (" + ", ".join(_FRAME_DROP) + ", avg_elevation_m, terrain_type), CAST(flood_event AS INTEGER) AS label"
    " FROM (SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in CLEAN_COLS
                                       if c not in ("reading_id", "station", "district", "date", "month", "year",
                                                    "day_of_year", "is_monsoon")) + ") FROM model)", "model"))
def q_feature_frame(spark, sf):
    """P7 + P14: forbidden and leakage-prone columns dropped, target as an INT label."""

    df = baseline.fixture_model_frame(spark, sf).select(*CLEAN_COLS)
    out = quality.feature_target_frame(df, extra_drop=["water_area_km2", "water_area_change",
                                                       "water_area_pct_change", "ds_idx"])
    return round_doubles(out)
