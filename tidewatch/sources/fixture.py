"""Readings, dimensions and field reports derived from the driver's tables.

The hazard tables the library works on are not among the driver's tables, so
they are derived from ``events`` (one reading per event, station = user,
district = region name) with dirt planted at fixed residues of ``event_id``
(bad dates, blank and sentinel rain, soil above 1, missing soil, humidity above
100, infinite percentage change, exact duplicate rows).  30 days of event time
are stretched to 1,080 calendar days so every month of three years occurs.

The same definitions exist as DuckDB SQL in ``tidewatch.plans.oracle`` so both
engines see the same rows.  Everything here is a plain DataFrame plan: one
shuffle (by station) for the lag / rolling inputs, broadcast of the 5-row
region table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.sources.tables import load_table

EPOCH = dt.datetime(2024, 1, 1)
FIRST_DAY = dt.date(2022, 1, 1)
SECONDS_PER_DAY = 2400  # 30 event days -> 1,080 calendar days


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load_table(spark, sf_dir, "events", ["event_id", "user_id", "ts", "value", "event_type", "props"])
    region = load_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    # the epoch as TIMESTAMP_NTZ from text: independent of the session time zone
    epoch = F.lit(EPOCH.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    day = F.floor(F.timestamp_diff("SECOND", epoch, F.col("ts")) / SECONDS_PER_DAY)
    e = ev.select(
        F.col("event_id").alias("reading_id"),
        F.col("user_id").alias("station"),
        (F.col("user_id") % 5).alias("dk"),
        "value",
        "event_type",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.date_add(F.lit(FIRST_DAY), day.cast("int")).alias("d"),
    )
    # region has 5 rows: broadcast is bounded by construction
    return e.join(F.broadcast(region), e.dk == region.r_regionkey).drop("r_regionkey") \
        .withColumnRenamed("r_name", "district")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw daily readings (FIXTURES.md §B); ``precipitation`` and ``date`` are text."""
    b = _events(spark, sf_dir)
    rid = F.col("reading_id")
    b = b.withColumn(
        "water_area_km2",
        F.when(rid % 31 == 0, F.lit(0.0)).otherwise((rid % 400).cast("double") / 2))
    b = b.withColumn(
        "soil", F.when(rid % 103 == 0, F.lit(None).cast("double")).otherwise((rid % 105).cast("double") / 100))
    w = Window.partitionBy("station").orderBy("d", "reading_id")
    prev = F.lag("water_area_km2").over(w)

    def rolling(c, n):
        return F.round(F.avg(c).over(w.rowsBetween(-n, 0)), 4)

    p = b.select(
        "*",
        prev.alias("prev_km2"),
        rolling("value", 2).alias("precip_3day_avg"),
        rolling("value", 6).alias("precip_7day_avg"),
        rolling(F.col("k") / 2, 2).alias("temp_3day_avg"),
        rolling("soil", 2).alias("soil_3day_avg"),
    )
    d = F.col("d")
    f = p.select(
        "reading_id",
        "station",
        "district",
        F.when(rid % 211 == 0, F.lit("31/31/2023"))
        .otherwise(F.concat_ws("/", F.month(d).cast("string"), F.dayofmonth(d).cast("string"),
                               F.year(d).cast("string"))).alias("date"),
        (F.lit(100.0) + F.col("dk").cast("double") * 50).alias("elevation"),
        (F.lit(24.0) + (F.col("dk") * F.col("dk")).cast("double") * 0.75).alias("latitude"),
        (F.lit(61.0) + F.col("dk").cast("double") * 1.25).alias("longitude"),
        ((F.col("k") - 50) / 10000).alias("evaporation"),
        F.when(rid % 89 == 0, F.lit("")).when(rid % 97 == 0, F.lit("-999"))
        .otherwise(F.col("value").cast("string")).alias("precipitation"),
        (F.lit(98000.0) + F.col("k") * 10).alias("pressure"),
        F.col("soil").alias("soil_moisture"),
        (F.col("k") / 2).alias("temperature"),
        (rid % 12).cast("double").alias("wind_speed"),
        F.when(rid % 197 == 0, F.lit(130.0)).otherwise(F.col("k")).alias("humidity"),
        "water_area_km2",
        "precip_3day_avg",
        "precip_7day_avg",
        "temp_3day_avg",
        "soil_3day_avg",
        F.dayofyear(d).alias("day_of_year"),
        F.month(d).alias("month"),
        F.year(d).alias("year"),
        F.month(d).isin(7, 8, 9).cast("int").alias("is_monsoon"),
        (F.col("water_area_km2") - F.col("prev_km2")).alias("water_area_change"),
        F.when(F.col("prev_km2") == 0, F.lit(float("inf")))
        .otherwise((F.col("water_area_km2") - F.col("prev_km2")) / F.col("prev_km2")).alias("water_area_pct_change"),
        (rid % 4).cast("double").alias("ds_idx"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("flood_event"),
    )
    # planted exact duplicates: every 53rd reading appears twice (a generator, one pass)
    copies = F.explode(F.when(rid % 53 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return f.select("*", copies.alias("_copy")).drop("_copy")


def terrain(spark: SparkSession, sf_dir: str, drop_last: bool = False) -> DataFrame:
    """Terrain dimension, one row per district (A2).  ``drop_last`` leaves one district out."""
    region = load_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    if drop_last:
        region = region.where(F.col("r_regionkey") != 4)
    return region.select(
        F.col("r_name").alias("district"),
        (F.lit(57.0) + F.col("r_regionkey").cast("double") * 100).alias("avg_elevation_m"),
        F.concat(F.lit("terrain "), F.col("r_name")).alias("terrain_type"),
    )


def impact_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regional impact rows (A3), one per nation, in nation order; some populations missing."""
    customer = load_table(spark, sf_dir, "customer", ["c_nationkey"])
    nation = load_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = load_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    per_nation = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    joined = per_nation.join(F.broadcast(nation), per_nation.c_nationkey == nation.n_nationkey) \
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("n_nationkey").cast("long").alias("row_seq"),
        F.col("r_name").alias("region"),
        F.when(F.col("n_nationkey") % 7 == 3, F.lit(None).cast("long"))
        .otherwise(F.col("n") * 10000).alias("affected_population"),
    )


def district_regions(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """District -> region map for the derived districts; one district stays unmapped unless ``whole``."""
    region = load_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return region.where(F.lit(whole) | (F.col("r_regionkey") != 4)).select(
        F.col("r_name").alias("district"), F.col("r_name").alias("region"))


def region_divisors(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """Districts per region used to split regional population; one region left to the default unless ``whole``."""
    region = load_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return region.where(F.lit(whole) | (F.col("r_regionkey") != 3)).select(
        F.col("r_name").alias("region"),
        F.when(F.col("r_regionkey") % 2 == 0, 2).otherwise(1).alias("divisor"))


def risk_profiles(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """Exposure profile per district; one district left to the default profile unless ``whole``."""
    region = load_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    k = F.col("r_regionkey").cast("double")
    return region.where(F.lit(whole) | (F.col("r_regionkey") != 0)).select(
        F.col("r_name").alias("district"),
        (F.lit(0.55) + k * 0.1).alias("exposure_factor"),
        (F.lit(0.05) + k * 0.01).alias("max_exposed_share"))


def field_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field report per event (A4): rain = 2 x value, some missing / invalid fields."""
    b = _events(spark, sf_dir)
    rid = F.col("reading_id")
    return b.select(
        rid.alias("report_id"),
        F.when(rid % 61 == 0, F.lit("ATLANTIS")).otherwise(F.col("district")).alias("district"),
        F.when(rid % 89 == 0, F.lit(None).cast("double")).otherwise(F.col("value") * 2).alias("rainfall_mm"),
        F.col("d").alias("selected_date"),
        F.element_at(F.array(F.lit("Dry"), F.lit("Moist"), F.lit("Saturated"), F.lit("Muddy")),
                     (rid % 4 + 1).cast("int")).alias("soil_condition"),
        F.when(rid % 2 == 0, F.lit("Yes")).otherwise(F.lit("No")).alias("visible_water"),
        (F.col("value") / 600).alias("score"),
    )


def score_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score / label pairs for the metric operators: score = value / 600, label = error event."""
    ev = load_table(spark, sf_dir, "events", ["event_id", "user_id", "value", "event_type"])
    return ev.select(
        F.col("event_id").alias("row_id"),
        (F.col("user_id") % 4).cast("int").alias("fold"),
        (F.col("value") / 600).alias("score"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        F.when(F.col("value") / 600 >= 0.1, 1).otherwise(0).alias("prediction"),
    )
