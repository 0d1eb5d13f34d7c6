"""Queries for the scenario jobs (C3 stress rows, C4 faulty-sensor imputation)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import rules
from tidewatch.plans import scenarios
from tidewatch.plans.catalogue import register, round_doubles
from tidewatch.plans.oracle import FAULTY_DISTRICT, SURGE_DISTRICTS, _SURGE_OUT, statement
from tidewatch.sources import fixture


@register("q_surge_rows", statement(
    "SELECT " + ", ".join(c if c in ("reading_id", "district", "date", "flood_event") else f"round({c}, 6) AS {c}"
                          for c in _SURGE_OUT) + " FROM s_aug", "s_aug"))
def q_surge_rows(spark, sf):
    """The table with one stress row appended per impacted district."""
    aug, _ = scenarios.surge(fixture.readings(spark, sf), SURGE_DISTRICTS)
    out = aug.withColumn("precipitation", rules.to_number("precipitation"))
    return round_doubles(out.select(*_SURGE_OUT))


@register("q_surge_audit", statement(f"""
SELECT district, concat(CAST(month(pd) AS VARCHAR), '/', CAST(day(pd) AS VARCHAR), '/', CAST(year(pd) AS VARCHAR)) AS original_date,
       concat(CAST(month(sdate) AS VARCHAR), '/', CAST(day(sdate) AS VARCHAR), '/', CAST(year(sdate) AS VARCHAR)) AS scenario_date,
       round_even(orig, 3) AS original_precipitation, round_even(newp, 3) AS scenario_precipitation,
       CAST(4.0 AS DOUBLE) AS spike_multiplier_applied
FROM s_rows""", "s_rows"))
def q_surge_audit(spark, sf):
    """C3 audit: source and scenario dates and rain per injected row."""
    _, audit = scenarios.surge(fixture.readings(spark, sf), SURGE_DISTRICTS)
    return audit


@register("q_sensor_impute", statement("""
SELECT faulty_district, faulty_date, round(original_precipitation, 6) AS original_precipitation,
       round_even(imputed, 3) AS imputed_precipitation, d1 AS donor_1, d2 AS donor_2,
       round_even(val1, 3) AS donor_value_1, round_even(val2, 3) AS donor_value_2
FROM c4_audit""", "c4_audit"))
def q_sensor_impute(spark, sf):
    """C4 audit: target date, donors and their values, imputed rain."""
    _, audit = scenarios.impute_faulty_sensor(fixture.readings(spark, sf), FAULTY_DISTRICT)
    out = audit.select("faulty_district", "faulty_date", "original_precipitation", "imputed_precipitation",
                       F.col("donor_districts")[0].alias("donor_1"), F.col("donor_districts")[1].alias("donor_2"),
                       F.col("donor_values")[0].alias("donor_value_1"), F.col("donor_values")[1].alias("donor_value_2"))
    return round_doubles(out)


@register("q_sensor_updated", statement("""
SELECT reading_id, district, date, round(precipitation, 6) AS precipitation,
       round(precip_3day_avg, 6) AS precip_3day_avg, round(precip_7day_avg, 6) AS precip_7day_avg
FROM c4_updated""", "c4_updated"))
def q_sensor_updated(spark, sf):
    """C4: the whole table with the target reading imputed and its rolling rain blended."""
    upd, _ = scenarios.impute_faulty_sensor(fixture.readings(spark, sf), FAULTY_DISTRICT)
    out = upd.select("reading_id", "district", "date", rules.to_number("precipitation").alias("precipitation"),
                     rules.to_number("precip_3day_avg").alias("precip_3day_avg"),
                     rules.to_number("precip_7day_avg").alias("precip_7day_avg"))
    return round_doubles(out)
