"""Queries for scoring rules, batch scoring, alerts and the stress audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import rules
from tidewatch.operators import alerts, lookups
from tidewatch.plans import baseline, scoring
from tidewatch.plans.catalogue import register, round_doubles
from tidewatch.plans.oracle import band_sql, case_map, guard_sql, statement
from tidewatch.sources import fixture


def fixture_context(spark, sf):
    """Baseline tables and exposure dimensions derived from the driver's tables."""
    model_df = baseline.fixture_model_frame(spark, sf)
    base = baseline.fixture_baseline(spark, sf)
    exposure = scoring.Exposure(fixture.district_regions(spark, sf), fixture.region_divisors(spark, sf),
                                fixture.risk_profiles(spark, sf),
                                lookups.region_population(fixture.impact_reports(spark, sf)))
    return model_df, base, exposure


@register("q_risk_band", statement(f"SELECT row_id, {band_sql('score')} AS risk_level FROM pairs", "pairs"))
def q_risk_band(spark, sf):
    """F1: probability -> level with closed upper edges (0.50 Medium, 0.75 High)."""
    return fixture.score_labels(spark, sf).select("row_id", rules.risk_band("score").alias("risk_level"))


@register("q_risk_band_half_open", statement(
    f"SELECT row_id, {band_sql('score * 4', False)} AS risk_level FROM pairs", "pairs"))
def q_risk_band_half_open(spark, sf):
    """F2: leaderboard bands with half-open edges (0.50 High, 0.75 Critical); score x 4 spreads levels."""
    return fixture.score_labels(spark, sf).select(
        "row_id", rules.risk_band(F.col("score") * 4, closed_upper=False).alias("risk_level"))


@register("q_confidence", statement("""
SELECT row_id, round(greatest(score, 1 - score) * 100, 6) AS confidence_pct,
       round_even(score * 100, 1) AS probability_pct FROM pairs""", "pairs"))
def q_confidence(spark, sf):
    """scoring confidence max(p, 1-p) x 100 and leaderboard p x 100 (half-even, 1 place)."""
    out = fixture.score_labels(spark, sf).select(
        "row_id", rules.confidence_pct("score").alias("confidence_pct"),
        rules.probability_pct("score").alias("probability_pct"))
    return round_doubles(out)


@register("q_guardrail", statement(f"""
SELECT report_id, base_level, {guard_sql('base_level', 'rainfall_mm', 'soil_condition', 'visible_water')} AS risk_level
FROM (SELECT *, {band_sql('score')} AS base_level FROM reports)""", "reports"))
def q_guardrail(spark, sf):
    """the safety override may only raise a level (first matching rule wins)."""
    df = fixture.field_reports(spark, sf).withColumn("base_level", rules.risk_band("score"))
    return df.select("report_id", "base_level",
                     rules.guardrail("base_level", "rainfall_mm", "soil_condition", "visible_water").alias("risk_level"))


@register("q_validate_reports", statement(
    "SELECT report_id, ok, CASE WHEN ok THEN '' ELSE 'Insufficient data — manual assessment recommended' END "
    "AS message FROM rep_valid", "rep_valid"))
def q_validate_reports(spark, sf):
    """reports with a missing field, rain outside [0, 500] or an unknown value are rejected."""
    _, base, _ = fixture_context(spark, sf)
    return scoring.validate(fixture.field_reports(spark, sf), base.allowed).select("report_id", "ok", "message")


FEATURES = ["month", "day_of_year", "is_monsoon", "terrain_type", "avg_elevation_m", "precipitation",
            "precip_3day_avg", "precip_7day_avg", "soil_moisture", "soil_3day_avg", "water_area_km2",
            "water_area_change", "water_area_pct_change", "rain_soil_interaction", "monsoon_cumulative_precip",
            "temperature", "humidity", "pressure", "evaporation"]
_TEXT_INT = ("month", "day_of_year", "is_monsoon", "terrain_type")


@register("q_report_features", statement(
    "SELECT report_id, " + ", ".join(c if c in _TEXT_INT else f"round({c}, 6) AS {c}" for c in FEATURES)
    + " FROM rep_feat", "rep_feat"))
def q_report_features(spark, sf):
    """F7 + J2 + J3 + J10: the model feature row of every report from its baseline."""
    _, base, _ = fixture_context(spark, sf)
    feats = scoring.report_features(fixture.field_reports(spark, sf), base)
    return round_doubles(feats.select("report_id", *FEATURES))


SCORED = ["report_id", "ok", "message", "risk_level_en", "risk_level_ur", "confidence_pct",
          "recommended_action_en", "recommended_action_ur", "population_risk_estimate", "risk_color"]


@register("q_score_reports", statement(
    "SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c == "confidence_pct" else c for c in SCORED)
    + ", CASE WHEN ok THEN base_level END AS base_level, "
      "CASE WHEN ok THEN round(flood_probability, 6) END AS flood_probability FROM rep_result", "rep_result"))
def q_score_reports(spark, sf):
    """Batch scoring with validation, band, people at risk, override and advisory."""
    _, base, exposure = fixture_context(spark, sf)
    out = scoring.score_reports(fixture.field_reports(spark, sf).drop("score"), base, exposure)
    return round_doubles(out.select(*SCORED, "base_level", "flood_probability"))


@register("q_alert_fanout", statement("SELECT * FROM fan_alerts", "fan_alerts"))
def q_alert_fanout(spark, sf):
    """J8 + C5 + U4 + F8 + F10: each report's conditions scored for every other known district;
    valid High / Critical results kept."""
    _, base, exposure = fixture_context(spark, sf)
    return scoring.alert_fanout(fixture.field_reports(spark, sf), base.allowed, base, exposure)


@register("q_alert_merge", statement("""
SELECT report_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY sev, lower(districts[1]),
         risk_level_en, risk_level_ur, recommended_action_en, recommended_action_ur) AS INTEGER) AS alert_rank,
       array_to_string(districts, ',') AS districts, risk_level_en, risk_level_ur, recommended_action_en,
       recommended_action_ur
FROM (SELECT report_id, risk_level_en, risk_level_ur, recommended_action_en, recommended_action_ur,
             list_sort(list(district)) AS districts,
             """ + case_map("risk_level_en", {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}, "99") + """ AS sev
      FROM fan_alerts GROUP BY ALL)""", "fan_alerts"))
def q_alert_merge(spark, sf):
    """C6 (A12 + O3): per report, alerts with the same advisory merged, ordered by severity."""
    _, base, exposure = fixture_context(spark, sf)
    merged = scoring.regional_alerts(fixture.field_reports(spark, sf), base.allowed, base, exposure)
    return merged.withColumn("districts", F.array_join("districts", ",")).withColumn(
        "alert_rank", F.col("alert_rank").cast("int"))


@register("q_alert_merge_all", statement("""
SELECT m.alert_rank, f.district, CAST(count(*) AS BIGINT) AS times, m.risk_level_en, m.merged
FROM (SELECT risk_level_en, risk_level_ur, recommended_action_en, recommended_action_ur, CAST(count(*) AS BIGINT) AS merged,
             row_number() OVER (ORDER BY """ + case_map("risk_level_en", {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}, "99") + """,
               lower(min(district)), risk_level_en, risk_level_ur, recommended_action_en, recommended_action_ur) AS alert_rank
      FROM fan_alerts GROUP BY 1, 2, 3, 4) m
JOIN fan_alerts f ON f.risk_level_en IS NOT DISTINCT FROM m.risk_level_en AND f.risk_level_ur IS NOT DISTINCT FROM m.risk_level_ur
  AND f.recommended_action_en IS NOT DISTINCT FROM m.recommended_action_en
  AND f.recommended_action_ur IS NOT DISTINCT FROM m.recommended_action_ur GROUP BY ALL""", "fan_alerts"))
def q_alert_merge_all(spark, sf):
    """A12 + O3 without grouping columns: alerts of all reports merged and ranked, with their districts."""
    _, base, exposure = fixture_context(spark, sf)
    merged = scoring.regional_alerts(fixture.field_reports(spark, sf), base.allowed, base, exposure)
    rows = merged.withColumn("district", F.explode("districts")).drop("alert_rank", "districts")
    alerts_, members = alerts.merge_all_alerts(rows)
    return members.join(alerts_.select("alert_rank", "risk_level_en", "merged"), "alert_rank")


@register("q_banner", statement("""
SELECT report_id, risk_level_en, string_agg(name, ', ' ORDER BY district) AS district_names FROM (
  SELECT f.*, replace(trim(f.district), '_', ' ') AS name FROM fan_alerts f) GROUP BY report_id, risk_level_en, risk_level_ur, recommended_action_en, recommended_action_ur""", "fan_alerts"))
def q_banner(spark, sf):
    """a merged alert's districts as one line of display names."""
    _, base, exposure = fixture_context(spark, sf)
    merged = scoring.regional_alerts(fixture.field_reports(spark, sf), base.allowed, base, exposure)
    return alerts.banner_text(merged).select("report_id", "risk_level_en", "district_names")


@register("q_stress_audit", statement(f"""
SELECT district, rainfall_mm, base_level,
       {guard_sql('base_level', 'rainfall_mm', "'Saturated'", "'Yes'")} AS risk_level_en,
       {case_map(guard_sql('base_level', 'rainfall_mm', "'Saturated'", "'Yes'"), __import__('tidewatch.functions.fixed', fromlist=['x']).RISK_LABELS_UR)} AS risk_level_ur,
       round_even(greatest(p, 1 - p) * 100, 1) AS confidence_pct
FROM (SELECT *, {band_sql('p')} AS base_level FROM (
  SELECT a.district, 500.0 AS rainfall_mm,
         least(1.0, ((CASE WHEN m.district IS NOT NULL THEN m.rain_soil_interaction ELSE d.rain_soil_interaction END)
           + coalesce(least(500.0, (CASE WHEN m.district IS NOT NULL THEN m.precip_7day_avg ELSE d.precip_7day_avg END) * 1.6), 0)) / 300.0) AS p
  FROM allowed a CROSS JOIN (SELECT max(date) + 1 AS sim FROM clean) s
  LEFT JOIN mbase m ON a.district = m.district AND month(s.sim) = m.month CROSS JOIN dbase d))""",
    "allowed", "clean", "mbase", "dbase"))
def q_stress_audit(spark, sf):
    """Every district at 500 mm, saturated, water visible, the day after the data ends."""
    model_df, base, exposure = fixture_context(spark, sf)
    sim = scoring.next_day_after(model_df)
    return scoring.stress_audit(base, exposure, sim)


@register("q_normalize_risk", statement(f"""
SELECT row_id, raw_level,
       CASE WHEN trim(raw_level) IN ('Low', 'Medium', 'High', 'Critical') THEN trim(raw_level)
            ELSE {case_map('lower(trim(raw_level))', {'low': 'Low', 'medium': 'Medium', 'high': 'High', 'critical': 'Critical'})}
       END AS risk_level
FROM (SELECT row_id, CASE row_id % 5 WHEN 0 THEN b WHEN 1 THEN upper(b) WHEN 2 THEN concat('  ', lower(b), ' ')
                          WHEN 3 THEN 'unknown' ELSE '' END AS raw_level
      FROM (SELECT row_id, {band_sql('score * 3')} AS b FROM pairs))""", "pairs"))
def q_normalize_risk(spark, sf):
    """F8: level text trimmed, exact match kept, else case-insensitive match, else null."""
    df = fixture.score_labels(spark, sf).withColumn("b", rules.risk_band(F.col("score") * 3))
    k = F.col("row_id") % 5
    raw = (F.when(k == 0, F.col("b")).when(k == 1, F.upper("b"))
           .when(k == 2, F.concat(F.lit("  "), F.lower("b"), F.lit(" "))).when(k == 3, F.lit("unknown"))
           .otherwise(F.lit("")))
    df = df.withColumn("raw_level", raw)
    return df.select("row_id", "raw_level", rules.normalize_risk("raw_level").alias("risk_level"))


@register("q_display_names", statement("""
SELECT report_id, replace(trim(concat(' ', replace(district, ' ', '_'), '  ')), '_', ' ') AS display_name,
       trim(concat(' ', soil_condition, ' ')) AS soil_trimmed
FROM reports""", "reports"))
def q_display_names(spark, sf):
    """F9 + F10: keys trimmed (Unicode white space) with underscores shown as blanks."""
    df = fixture.field_reports(spark, sf)
    key = F.concat(F.lit(" "), F.regexp_replace("district", " ", "_"), F.lit("  "))
    return df.select("report_id", rules.display_name(key).alias("display_name"),
                     rules.unicode_trim(F.concat(F.lit(" "), F.col("soil_condition"), F.lit(" "))).alias("soil_trimmed"))
