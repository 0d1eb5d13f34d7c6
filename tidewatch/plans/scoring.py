"""Batch scoring of field reports, regional alerts, stress audit.

One narrow plan per batch: checked broadcast joins to the baseline tables and
the exposure dimensions, Column expressions for every rule, and (optionally)
one model ``transform``.  There is no per-report call.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed, rules
from tidewatch.operators import alerts, joins, lookups
from tidewatch.plans.baseline import Baseline

REPORT_COLS = ["district", "rainfall_mm", "selected_date", "soil_condition", "visible_water"]


@dataclass
class Exposure:
    district_region: DataFrame
    divisors: DataFrame
    profiles: DataFrame
    populations: DataFrame


def validate(reports: DataFrame, allowed: DataFrame) -> DataFrame:
    """``ok`` and ``message`` per report (district known = present in ``allowed``)."""
    known = allowed.select(F.col("district").alias("_ad"), F.lit(True).alias("_known"))
    out = reports.join(joins.checked_dimension(known, ["_ad"]), F.col("district") == F.col("_ad"), "left")
    ok = rules.report_is_valid("rainfall_mm", "selected_date", "district", "soil_condition", "visible_water",
                               F.coalesce(F.col("_known"), F.lit(False)))
    return out.withColumn("ok", ok).withColumn("message", rules.validation_message("ok")).drop("_ad", "_known")


def report_features(reports: DataFrame, base: Baseline, water_from_lags: bool = False) -> DataFrame:
    """F7 + J2 + J3 + J10: the model's feature row for every report.

    Water: the baseline holds only lagged water columns, so by default the
    current water level starts from 0 (as the source does); ``water_from_lags``
    starts from the district-month medians of the lag columns instead.
    """
    d = F.col("selected_date")
    rain = F.col("rainfall_mm").cast("double")
    df = reports.withColumns({"month": F.month(d), "day_of_year": F.dayofyear(d), "year": F.year(d),
                              "is_monsoon": rules.monsoon_flag(d)})
    df = lookups.with_baseline(df, base.month, base.default)
    df = lookups.with_terrain(df, base.terrain, "base_avg_elevation_m")
    soil = lookups.soil_value("soil_condition")
    yes = F.col("visible_water") == "Yes"
    if water_from_lags:
        w_base = F.coalesce(F.col("base_water_area_km2_lag1"), F.lit(0.0))
        c_base = F.coalesce(F.col("base_water_area_change_lag1"), F.lit(0.0))
    else:
        w_base, c_base = F.lit(0.0), F.lit(0.0)
    km2 = F.when(yes, F.greatest(w_base, w_base * 1.2 + 5.0)).otherwise(F.greatest(F.lit(0.0), w_base * 0.8))
    change = F.when(yes, F.greatest(F.lit(1.0), F.abs(c_base) + 2.5)).otherwise(F.least(F.lit(0.0), c_base))
    df = df.withColumns({"water_area_km2": km2, "water_area_change": change})
    prev = F.greatest(F.col("water_area_km2") - F.col("water_area_change"), F.lit(fixed.PCT_CHANGE_FLOOR))
    df = df.withColumns({
        "precipitation": rain,
        "precip_3day_avg": F.lit(fixed.REPORT_BLEND_3DAY) * rain
        + F.lit(1 - fixed.REPORT_BLEND_3DAY) * F.col("base_precip_3day_avg"),
        "precip_7day_avg": F.lit(fixed.REPORT_BLEND_7DAY) * rain
        + F.lit(1 - fixed.REPORT_BLEND_7DAY) * F.col("base_precip_7day_avg"),
        "soil_moisture": soil,
        "soil_3day_avg": F.lit(fixed.REPORT_SOIL_BASE_SHARE) * F.col("base_soil_3day_avg")
        + F.lit(1 - fixed.REPORT_SOIL_BASE_SHARE) * soil,
        "water_area_pct_change": F.col("water_area_change") / prev,
        "rain_soil_interaction": rain * soil,
        "monsoon_cumulative_precip": F.when(F.col("is_monsoon") == 1,
                                            F.col("base_monsoon_cumulative_precip") + rain).otherwise(F.lit(0.0)),
        "temperature": F.col("base_temperature"),
        "humidity": F.col("base_humidity"),
        "pressure": F.col("base_pressure"),
        "evaporation": F.col("base_evaporation"),
    })
    if water_from_lags:
        df = df.withColumns({"water_area_km2_lag1": F.col("base_water_area_km2_lag1"),
                             "water_area_change_lag1": F.col("base_water_area_change_lag1"),
                             "water_area_pct_change_lag1": F.col("base_water_area_pct_change_lag1")})
    else:
        df = df.withColumns({"water_area_km2_lag1": F.col("water_area_km2"),
                             "water_area_change_lag1": F.col("water_area_change"),
                             "water_area_pct_change_lag1": F.col("water_area_pct_change")})
    return df


def stand_in_probability() -> Column:
    """A deterministic probability from the feature row, used where no model is given
    (tests and SQL checks): (rain x soil + 7-day rain) / 300, capped at 1."""
    return F.least(F.lit(1.0), (F.col("rain_soil_interaction") + F.coalesce(F.col("precip_7day_avg"), F.lit(0.0)))
                   / F.lit(300.0))


def model_probability(model, features: DataFrame) -> DataFrame:
    """Positive-class probability from a fitted model (adds ``probability_1``)."""
    from tidewatch.operators import learn

    return learn.predict(model, features).withColumnRenamed("score", "probability_1").drop("prediction")


def advisory(level: Column) -> dict[str, Column]:
    """Urdu label, actions and colour for a level."""
    return {
        "risk_level_ur": rules.literal_map(fixed.RISK_LABELS_UR)[level],
        "recommended_action_en": rules.literal_map({k: v["en"] for k, v in fixed.RISK_ACTIONS.items()})[level],
        "recommended_action_ur": rules.literal_map({k: v["ur"] for k, v in fixed.RISK_ACTIONS.items()})[level],
        "risk_color": rules.literal_map(fixed.RISK_COLORS)[level],
    }


def score_reports(reports: DataFrame, base: Baseline, exposure: Exposure, probability: Column | None = None,
                  model=None, water_from_lags: bool = False) -> DataFrame:
    """Validate -> features -> probability -> band -> people -> override -> advisory.

    Invalid reports keep ``ok = false`` and the message, with null results.
    """
    checked = validate(reports, base.allowed)
    feats = report_features(checked, base, water_from_lags)
    if model is not None:
        feats = model_probability(model, feats)
        p = F.col("probability_1")
    else:
        p = probability if probability is not None else stand_in_probability()
    feats = feats.withColumn("flood_probability", p)
    feats = lookups.with_exposure(feats, exposure.district_region, exposure.divisors, exposure.profiles,
                                  exposure.populations)
    conf = rules.confidence_pct("flood_probability")
    out = feats.withColumns({"base_level": rules.risk_band("flood_probability"), "_conf": conf})
    out = out.withColumn("confidence_pct", F.bround(F.col("_conf"), 1))
    out = out.withColumn("_level", rules.guardrail("base_level", "rainfall_mm", "soil_condition", "visible_water"))
    people_first = rules.people_at_risk("base_level", "_conf", "regional_population", "divisor",
                                        "exposure_factor", "max_exposed_share")
    people_after = rules.people_at_risk("_level", "confidence_pct", "regional_population", "divisor",
                                        "exposure_factor", "max_exposed_share")
    out = out.withColumn("population_risk_estimate",
                         F.when(F.col("_level") == F.col("base_level"), people_first).otherwise(people_after))
    out = out.withColumn("risk_level_en", F.col("_level")).withColumns(advisory(F.col("_level")))
    result_cols = ["risk_level_en", "risk_level_ur", "confidence_pct", "recommended_action_en",
                   "recommended_action_ur", "population_risk_estimate", "risk_color", "base_level",
                   "flood_probability"]
    ok = F.col("ok")
    return out.select(*[c for c in reports.columns],
                      "ok", "message",
                      *[F.when(ok, F.col(c)).alias(c) for c in result_cols])


MAX_FANOUT = 100_000   # districts an alert fan-out accepts


# --- C6: regional alerts ---------------------------------------------------------------------

def alert_fanout(conditions: DataFrame, districts: DataFrame, base: Baseline, exposure: Exposure,
                 probability: Column | None = None, model=None, cond_id: str = "report_id",
                 focus: str = "district") -> DataFrame:
    """J8 + C5 + U4: every known district scored under each condition set, the focus
    district left out, keeping valid High / Critical results (normalised, trimmed).

    Distinct condition sets are scored once; only alerts are joined back to the
    reports that share the conditions.
    """
    given = ["rainfall_mm", "selected_date", "soil_condition", "visible_water"]
    # one row: the district names as an array, refused beyond a bound; every distinct condition set explodes it
    names = districts.agg(F.array_sort(F.collect_set("district")).alias("_names"))
    names = names.select(F.when(F.size("_names") <= MAX_FANOUT, F.col("_names")).otherwise(
        F.raise_error(F.lit(f"more than {MAX_FANOUT} districts to fan out to"))).alias("_names"))
    fan = conditions.select(*given).distinct().crossJoin(F.broadcast(names)) \
        .select(*given, F.explode("_names").alias("district"))
    scored = score_reports(fan, base, exposure, probability, model)
    level = rules.normalize_risk("risk_level_en")
    alerts_ = scored.where(F.col("ok") & level.isin("High", "Critical")).select(
        *[F.col(c).alias(f"_{c}") for c in given], F.col("district").alias("_fan"), level.alias("risk_level_en"),
        rules.unicode_trim("risk_level_ur").alias("risk_level_ur"),
        rules.unicode_trim("recommended_action_en").alias("recommended_action_en"),
        rules.unicode_trim("recommended_action_ur").alias("recommended_action_ur"))
    same = F.lit(True)
    for c in given:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    back = conditions.select(cond_id, F.col(focus).alias("_focus"), *given).join(alerts_, same) \
        .where(~F.col("_fan").eqNullSafe(F.col("_focus")))
    return back.select(cond_id, F.col("_fan").alias("district"), "risk_level_en", "risk_level_ur",
                       "recommended_action_en", "recommended_action_ur")


def regional_alerts(conditions: DataFrame, districts: DataFrame, base: Baseline, exposure: Exposure,
                    probability: Column | None = None, model=None, cond_id: str = "report_id") -> DataFrame:
    """Fan-out, then merge by identical advisory and order per condition set."""
    rows = alert_fanout(conditions, districts, base, exposure, probability, model, cond_id)
    return alerts.merge_alerts(rows, [cond_id])


# --- C7: stress audit ------------------------------------------------------------------------

def stress_rows(base: Baseline, sim_date: Column) -> DataFrame:
    """Every known district at 500 mm with scaled baseline averages (the extreme scenario)."""
    districts = base.allowed.select("district")
    df = districts.withColumn("selected_date", sim_date)
    d = F.col("selected_date")
    df = df.withColumns({"month": F.month(d), "day_of_year": F.dayofyear(d), "year": F.year(d),
                         "is_monsoon": rules.monsoon_flag(d)})
    df = lookups.with_baseline(df, base.month, base.default)
    df = lookups.with_terrain(df, base.terrain, "base_avg_elevation_m")
    rain = F.lit(fixed.STRESS_RAIN_MM)
    df = df.withColumns({
        "rainfall_mm": rain, "soil_condition": F.lit("Saturated"), "visible_water": F.lit("Yes"),
        "precipitation": rain,
        # the baseline always carries these keys, so a missing median stays missing
        # and the cap applies (least() skips nulls, as min(500, nan) does)
        "precip_3day_avg": F.least(F.lit(500.0), F.col("base_precip_3day_avg") * 1.8),
        "precip_7day_avg": F.least(F.lit(500.0), F.col("base_precip_7day_avg") * 1.6),
        "soil_moisture": F.least(F.lit(1.0), F.col("base_soil_moisture") + 0.2),
        "soil_3day_avg": F.least(F.lit(1.0), F.col("base_soil_3day_avg") + 0.15),
        "water_area_km2": F.lit(5.0 * 1.7),
        "water_area_change": F.lit(max(1.0, 1.0 + 3.0)),
        "temperature": F.col("base_temperature"), "humidity": F.col("base_humidity"),
        "pressure": F.col("base_pressure"), "evaporation": F.col("base_evaporation"),
        "rain_soil_interaction": F.col("base_rain_soil_interaction"),
        "monsoon_cumulative_precip": F.col("base_monsoon_cumulative_precip"),
        "water_area_km2_lag1": F.col("base_water_area_km2_lag1"),
        "water_area_change_lag1": F.col("base_water_area_change_lag1"),
        "water_area_pct_change_lag1": F.col("base_water_area_pct_change_lag1"),
    })
    prev = F.greatest(F.col("water_area_km2") - F.col("water_area_change"), F.lit(fixed.PCT_CHANGE_FLOOR))
    return df.withColumn("water_area_pct_change", F.col("water_area_change") / prev)


def stress_audit(base: Baseline, exposure: Exposure, sim_date: Column, probability: Column | None = None,
                 model=None) -> DataFrame:
    """Score every district under the extreme scenario, apply the override, check levels."""
    df = stress_rows(base, sim_date)
    if model is not None:
        df = model_probability(model, df)
        p = F.col("probability_1")
    else:
        p = probability if probability is not None else stand_in_probability()
    df = df.withColumn("flood_probability", p)
    df = lookups.with_exposure(df, exposure.district_region, exposure.divisors, exposure.profiles,
                               exposure.populations)
    df = df.withColumns({"base_level": rules.risk_band("flood_probability"),
                         "confidence_pct": F.bround(rules.confidence_pct("flood_probability"), 1)})
    df = df.withColumn("risk_level_en", rules.guardrail("base_level", "rainfall_mm", "soil_condition", "visible_water"))
    level_ok = F.assert_true(F.col("risk_level_en").isin(*fixed.RISK_LEVELS), F.lit("invalid classification"))
    return df.select("district", "rainfall_mm", "base_level",
                     F.when(level_ok.isNull(), F.col("risk_level_en")).alias("risk_level_en"),
                     rules.literal_map(fixed.RISK_LABELS_UR)[F.col("risk_level_en")].alias("risk_level_ur"),
                     "confidence_pct")


def next_day_after(df: DataFrame, date_col: str = "date", default: str = fixed.SURGE_DEFAULT_LAST_DATE) -> Column:
    """A11 + F12: the day after the latest date (or after ``default``) as a scalar subquery column."""
    last = df.agg(F.coalesce(F.max(date_col), F.lit(default).cast("date")).alias("_last"))
    return F.date_add(F.lit(last.first()["_last"]), 1)
