"""Queries for joins, baselines and neighbour search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import rules
from tidewatch.operators import lookups
from tidewatch.plans import baseline
from tidewatch.plans.catalogue import register, round_doubles
from tidewatch.plans.oracle import BASE_COLS, MONTH_BASE_COLS, statement
from tidewatch.sources import fixture


@register("q_terrain_join", statement("""
SELECT reading_id, district, round(avg_elevation_m, 6) AS avg_elevation_m, terrain_type
FROM clean LEFT JOIN terrain_short USING (district)""", "clean", "terrain_short"))
def q_terrain_join(spark, sf):
    """Terrain attached by district (one district missing from the dimension)."""
    df = baseline.fixture_model_frame(spark, sf, short_terrain=True)
    return round_doubles(df.select("reading_id", "district", "avg_elevation_m", "terrain_type"))


@register("q_baseline", statement(
    "SELECT district, month, " + ", ".join(f"round({c}, 6) AS {c}" for c in MONTH_BASE_COLS) + " FROM mbase",
    "mbase"))
def q_baseline(spark, sf):
    """A1 (flagship): median of every baseline feature per (district, month) after cleaning."""
    df = baseline.fixture_model_frame(spark, sf)
    return round_doubles(lookups.month_baseline(df).select("district", "month", *MONTH_BASE_COLS))


@register("q_default_row", statement(
    "SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in BASE_COLS) + " FROM dbase", "dbase"))
def q_default_row(spark, sf):
    """A2: one row of global medians (the lookup fallback)."""
    df = baseline.fixture_model_frame(spark, sf)
    return round_doubles(lookups.default_baseline(df).select(*BASE_COLS))


@register("q_terrain_lookup", statement(
    "SELECT district, terrain_type, round(avg_elevation_m, 6) AS avg_elevation_m FROM tlookup", "tlookup"))
def q_terrain_lookup(spark, sf):
    """W5 + J4: first terrain entry per district in row order, completed from the dimension."""
    df = baseline.fixture_model_frame(spark, sf)
    return round_doubles(lookups.terrain_lookup(df, fixture.terrain(spark, sf), ["date", "reading_id"]))


@register("q_allowed_districts", statement("SELECT district FROM allowed", "allowed"))
def q_allowed_districts(spark, sf):
    """Districts from the data and the terrain dimension, distinct, nulls dropped."""
    df = baseline.fixture_model_frame(spark, sf)
    return lookups.allowed_districts(df, fixture.terrain(spark, sf))


@register("q_baseline_lookup", statement("""
SELECT r.report_id, (m.district IS NOT NULL) AS base_found,
       round(CASE WHEN m.district IS NOT NULL THEN m.precip_3day_avg ELSE d.precip_3day_avg END, 6) AS base_precip_3day_avg,
       round(CASE WHEN m.district IS NOT NULL THEN m.soil_3day_avg ELSE d.soil_3day_avg END, 6) AS base_soil_3day_avg,
       round(CASE WHEN m.district IS NOT NULL THEN m.water_area_km2_lag1 ELSE d.water_area_km2_lag1 END, 6) AS base_water_area_km2_lag1,
       round(CASE WHEN m.district IS NOT NULL THEN m.monsoon_cumulative_precip ELSE d.monsoon_cumulative_precip END, 6) AS base_monsoon_cumulative_precip
FROM reports r LEFT JOIN mbase m ON r.district = m.district AND month(r.selected_date) = m.month
CROSS JOIN dbase d""", "reports", "mbase", "dbase"))
def q_baseline_lookup(spark, sf):
    """Each report gets its (district, month) baseline row, else the whole default row."""
    df = baseline.fixture_model_frame(spark, sf)
    reports = fixture.field_reports(spark, sf).withColumn("month", F.month("selected_date"))
    out = lookups.with_baseline(reports, lookups.month_baseline(df), lookups.default_baseline(df))
    return round_doubles(out.select("report_id", "base_found", "base_precip_3day_avg", "base_soil_3day_avg",
                                    "base_water_area_km2_lag1", "base_monsoon_cumulative_precip"))


@register("q_region_population", statement("SELECT region, affected_population FROM popn", "popn"))
def q_region_population(spark, sf):
    """Population per region (missing figures dropped, later row wins)."""
    return lookups.region_population(fixture.impact_reports(spark, sf))


@register("q_population_at_risk", statement("""
SELECT report_id, district, level, round(conf, 6) AS confidence_pct,
  CAST(CASE WHEN pop IS NULL THEN 0 ELSE round_even(greatest(
      CASE level WHEN 'Low' THEN 50 WHEN 'Medium' THEN 150 WHEN 'High' THEN 300 ELSE 500 END,
      least(pop / greatest(coalesce(divisor, 1), 1) *
              (CASE level WHEN 'Low' THEN 0.002 WHEN 'Medium' THEN 0.007 WHEN 'High' THEN 0.015 ELSE 0.030 END)
              * (0.6 + 0.4 * (conf / 100.0)) * coalesce(ef, 0.75),
            pop / greatest(coalesce(divisor, 1), 1) *
              least(CASE level WHEN 'Low' THEN 0.01 WHEN 'Medium' THEN 0.03 WHEN 'High' THEN 0.06 ELSE 0.10 END,
                    coalesce(ms, 0.06)))), -2) END AS BIGINT) AS population_risk_estimate
FROM (
  SELECT r.report_id, r.district,
         CASE WHEN r.score < 0.25 THEN 'Low' WHEN r.score <= 0.5 THEN 'Medium' WHEN r.score <= 0.75 THEN 'High'
              ELSE 'Critical' END AS level,
         greatest(r.score, 1 - r.score) * 100 AS conf,
         p.affected_population AS pop, v.divisor, f.exposure_factor AS ef, f.max_exposed_share AS ms
  FROM reports r LEFT JOIN district_region_part dr ON r.district = dr.district
  LEFT JOIN popn p ON dr.region = p.region
  LEFT JOIN region_divisor_part v ON dr.region = v.region
  LEFT JOIN risk_profile_part f ON r.district = f.district)""",
    "reports", "district_region_part", "popn", "region_divisor_part", "risk_profile_part"))
def q_population_at_risk(spark, sf):
    """J5 + F6: people at risk per report from the regional figure, divisor and profile."""
    reports = fixture.field_reports(spark, sf)
    df = lookups.with_exposure(reports, fixture.district_regions(spark, sf, whole=False), fixture.region_divisors(spark, sf, whole=False),
                               fixture.risk_profiles(spark, sf, whole=False),
                               lookups.region_population(fixture.impact_reports(spark, sf)))
    df = df.withColumns({"level": rules.risk_band("score"), "confidence_pct": rules.confidence_pct("score")})
    df = df.withColumn("population_risk_estimate", rules.people_at_risk(
        "level", "confidence_pct", "regional_population", "divisor", "exposure_factor", "max_exposed_share"))
    return round_doubles(df.select("report_id", "district", "level", "confidence_pct", "population_risk_estimate"))


@register("q_centroids", statement("SELECT key, round(lat, 6) AS lat, round(lon, 6) AS lon FROM cent", "cent"))
def q_centroids(spark, sf):
    """A5: mean coordinates per district (rows with both coordinates, bad dates included)."""
    return round_doubles(lookups.centroids(fixture.readings(spark, sf)))


@register("q_nearest_keys", statement(
    "SELECT target, neighbour, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM knn", "knn"))
def q_nearest_keys(spark, sf):
    """The two nearest other districts of every district (ties by name), grid search."""
    out = lookups.nearest_keys(lookups.centroids(fixture.readings(spark, sf)), 2)
    return round_doubles(out.select("target", "neighbour", "dist", F.col("rank").cast("int")))


def donor_values(spark, sf):
    raw = fixture.readings(spark, sf)
    rows = raw.select("district", "reading_id", rules.parse_date("date").alias("d"),
                      rules.to_number("precipitation").alias("precipitation"))
    nn = lookups.nearest_keys(lookups.centroids(raw), 2)
    tdate = rows.where(F.col("d").isNotNull()).groupBy(F.col("district").alias("target")) \
        .agg(F.max("d").alias("target_date"))
    targets = nn.select("target", F.col("neighbour").alias("donor")).join(tdate, "target")
    return lookups.nearest_in_time(rows, targets, "district", "d", "precipitation", "reading_id")


@register("q_nearest_in_time", statement(
    "SELECT target, donor, round(precipitation, 6) AS precipitation, CAST(date_gap AS INTEGER) AS date_gap "
    "FROM donorval", "donorval"))
def q_nearest_in_time(spark, sf):
    """Each neighbour's rain on the target's latest date, else nearest in time."""
    return round_doubles(donor_values(spark, sf).select("target", "donor", "precipitation",
                                                        F.col("date_gap").cast("int")))
