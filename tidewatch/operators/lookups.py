"""Lookups, baselines and neighbour search.

Baselines are flat tables keyed by (district, month) plus a one-row default;
lookups are equi-joins with a row-level fallback to the default row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import fixed, rules
from tidewatch.operators import joins, quantiles, timeseries
from tidewatch.session import cut_lineage


# --- J1 / J4 / W5: terrain -----------------------------------------------------------------

def attach_terrain(df: DataFrame, terrain: DataFrame, key: str = "district") -> DataFrame:
    """Left join of the terrain dimension; its key must be unique (many-to-one)."""
    return joins.join_dimension(df, terrain, [key], "left", unique=True)


def terrain_lookup(model_df: DataFrame, terrain: DataFrame, order_cols: list[str],
                   key: str = "district") -> DataFrame:
    """W5 + J4: first (terrain_type, avg_elevation_m) per district in row order, then the
    dimension's districts that the data lacks (entries from the data win)."""
    first = timeseries.first_row(
        model_df.where(F.col(key).isNotNull()).select(key, "terrain_type", "avg_elevation_m", *order_cols),
        [key], order_cols).select(key, "terrain_type", F.col("avg_elevation_m").cast("double"))
    extra = terrain.where(F.col(key).isNotNull()).join(first.select(key), key, "left_anti") \
        .select(key, "terrain_type", F.col("avg_elevation_m").cast("double"))
    return first.unionByName(extra)


def allowed_districts(model_df: DataFrame, terrain: DataFrame, key: str = "district") -> DataFrame:
    """Districts known to the data or to the terrain dimension (nulls dropped)."""
    return model_df.select(key).union(terrain.select(key)).where(F.col(key).isNotNull()).distinct()


# --- A1 / A2: baselines -------------------------------------------------------------------------

def baseline_columns(df: DataFrame) -> list[str]:
    cols = [c for c in fixed.MODEL_NUMERIC_FEATURES + ["year"] if c in df.columns]
    return [c for c, t in df.dtypes if c in cols and t not in ("string", "date", "boolean")]


def month_baseline(model_df: DataFrame, keys: list[str] = ("district", "month"),
                   method: str = "exact") -> DataFrame:
    """A1: median of every baseline feature per (district, month); null keys dropped."""
    cols = [c for c in baseline_columns(model_df) if c not in keys]
    return quantiles.medians(model_df, cols, list(keys), method)


def default_baseline(model_df: DataFrame, method: str = "exact") -> DataFrame:
    """A2: one row of global medians of the baseline features."""
    return quantiles.medians(model_df, baseline_columns(model_df), (), method)


# --- J2 / J3: report lookups ----------------------------------------------------------------------

def with_baseline(reports: DataFrame, month_base: DataFrame, default_row: DataFrame,
                  district: str = "district", month: str = "month", prefix: str = "base_") -> DataFrame:
    """Every baseline column for the report's (district, month) if that row exists,
    otherwise the whole default row (a row fallback, not per column)."""
    cols = [c for c in month_base.columns if c not in ("district", "month")]
    mb = month_base.select(F.col("district").alias("_bd"), F.col("month").alias("_bm"),
                           F.lit(True).alias("_hit"), *[F.col(c).alias(f"_b_{c}") for c in cols])
    dflt = default_row.select(*[F.col(c).alias(f"_d_{c}") for c in cols if c in default_row.columns])
    out = reports.join(joins.checked_dimension(mb, ["_bd", "_bm"]),
                       (F.col(district) == F.col("_bd")) & (F.col(month) == F.col("_bm")), "left")
    out = out.crossJoin(F.broadcast(dflt))  # one row
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = out.withColumns({f"{prefix}{c}": F.when(hit, F.col(f"_b_{c}")).otherwise(
        F.col(f"_d_{c}") if c in default_row.columns else F.lit(None)) for c in cols})
    out = out.withColumn(f"{prefix}found", hit)
    return out.drop("_bd", "_bm", "_hit", *[f"_b_{c}" for c in cols], *[f"_d_{c}" for c in cols])


def with_terrain(reports: DataFrame, lookup: DataFrame, fallback_elevation, district: str = "district") -> DataFrame:
    """Terrain type and elevation for the district, else ("Unknown", fallback)."""
    t = lookup.select(F.col("district").alias("_td"), F.col("terrain_type").alias("_tt"),
                      F.col("avg_elevation_m").alias("_te"), F.lit(True).alias("_thit"))
    out = reports.join(joins.checked_dimension(t, ["_td"]), F.col(district) == F.col("_td"), "left")
    hit = F.coalesce(F.col("_thit"), F.lit(False))
    out = out.withColumns({
        "terrain_type": F.when(hit, F.col("_tt")).otherwise(F.lit(fixed.UNKNOWN_TERRAIN)),
        "avg_elevation_m": F.when(hit, F.col("_te")).otherwise(rules.col(fallback_elevation)).cast("double"),
    })
    return out.drop("_td", "_tt", "_te", "_thit")


def soil_value(c) -> "F.Column":
    """Soil condition -> numeric moisture."""
    return rules.literal_map(fixed.SOIL_CONDITION_TO_VALUE)[rules.col(c)]


# --- A13 / J5: people exposed ------------------------------------------------------------------------

def region_population(impact: DataFrame, seq_col: str = "row_seq") -> DataFrame:
    """Population per region; rows without a figure dropped, the later row wins."""
    return impact.where(F.col("affected_population").isNotNull() & F.col("region").isNotNull()) \
        .groupBy("region").agg(F.max_by("affected_population", seq_col).cast("long").alias("affected_population"))


def reference_exposure_tables(spark):
    """The fixed district -> region / divisor / profile tables as DataFrames."""
    regions = spark.createDataFrame(list(fixed.DISTRICT_TO_REGION.items()), "district string, region string")
    divisors = spark.createDataFrame(list(fixed.REGION_DISTRICT_DIVISOR.items()), "region string, divisor int")
    profiles = spark.createDataFrame(
        [(d, p["exposure_factor"], p["max_exposed_share"]) for d, p in fixed.DISTRICT_RISK_PROFILE.items()],
        "district string, exposure_factor double, max_exposed_share double")
    return regions, divisors, profiles


def with_exposure(df: DataFrame, district_region: DataFrame, divisors: DataFrame, profiles: DataFrame,
                  populations: DataFrame, district: str = "district") -> DataFrame:
    """Region, regional population, divisor and exposure profile per district.

    Missing region or population -> population null (F6 gives 0); missing divisor
    -> 1; missing profile -> the default profile.
    """
    reg = district_region.select(F.col("district").alias("_xd"), F.col("region").alias("_xr"))
    pop = populations.select(F.col("region").alias("_pr"), F.col("affected_population").alias("_xpop"))
    div = divisors.select(F.col("region").alias("_dr"), F.col("divisor").alias("_xdiv"))
    prof = profiles.select(F.col("district").alias("_fd"), F.col("exposure_factor").alias("_xef"),
                           F.col("max_exposed_share").alias("_xms"))
    out = df.join(joins.checked_dimension(reg, ["_xd"]), F.col(district) == F.col("_xd"), "left")
    out = out.join(joins.checked_dimension(pop, ["_pr"]), F.col("_xr") == F.col("_pr"), "left")
    out = out.join(joins.checked_dimension(div, ["_dr"]), F.col("_xr") == F.col("_dr"), "left")
    out = out.join(joins.checked_dimension(prof, ["_fd"]), F.col(district) == F.col("_fd"), "left")
    out = out.withColumns({
        "region": F.col("_xr"),
        "regional_population": F.col("_xpop"),
        "divisor": F.coalesce(F.col("_xdiv"), F.lit(fixed.DEFAULT_DIVISOR)),
        "exposure_factor": F.coalesce(F.col("_xef"), F.lit(fixed.DEFAULT_RISK_PROFILE["exposure_factor"])),
        "max_exposed_share": F.coalesce(F.col("_xms"), F.lit(fixed.DEFAULT_RISK_PROFILE["max_exposed_share"])),
    })
    return out.drop("_xd", "_xr", "_pr", "_xpop", "_dr", "_xdiv", "_fd", "_xef", "_xms")


# --- A5 / J6: nearest keys ------------------------------------------------------------------------------

def centroids(df: DataFrame, key: str = "district", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """A5: mean coordinates per key over rows where both coordinates are present."""
    la, lo = rules.to_number(lat), rules.to_number(lon)
    return df.select(F.col(key).alias("key"), la.alias("lat"), lo.alias("lon")) \
        .where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("key").isNotNull()) \
        .groupBy("key").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def nearest_to_one(cents: DataFrame, target_key, k: int) -> DataFrame:
    """J6 for a single target: distance of every other key to it, k smallest (dist, key)."""
    t = cents.where(F.col("key") == F.lit(target_key)).select(
        F.col("key").alias("target"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    cand = cents.where(F.col("key") != F.lit(target_key)).crossJoin(F.broadcast(t))  # t has <= 1 row
    cand = cand.withColumn("dist", F.sqrt((F.col("lat") - F.col("tlat")) ** 2 + (F.col("lon") - F.col("tlon")) ** 2))
    best = cand.orderBy("dist", "key").limit(k)  # k rows, ranked below
    w = Window.partitionBy("target").orderBy("dist", "key")
    return best.withColumn("rank", F.row_number().over(w)).select("target", F.col("key").alias("neighbour"), "dist", "rank")


def nearest_keys(cents: DataFrame, k: int) -> DataFrame:
    """J6 for every key as target, exact, without an all-pairs join.

    Keys are placed on a square grid sized so that a cell holds about ``k`` keys;
    each target looks at the cells within ``r`` rings.  Anything outside lies
    farther than ``r * cell``, so a target whose k-th candidate is within that
    distance is final; the rest retry with twice the radius, until one that
    covers the whole grid.  Ties break by key.  Each round's targets and results
    are written, so the plan does not grow with the rounds.
    """
    stats = cents.agg(F.count(F.lit(1)).alias("n"), F.min("lat").alias("a0"), F.max("lat").alias("a1"),
                      F.min("lon").alias("b0"), F.max("lon").alias("b1")).first()
    n = int(stats["n"])
    if n == 0:
        return cents.sparkSession.createDataFrame([], "target string, neighbour string, dist double, rank int")
    extent = max(stats["a1"] - stats["a0"], stats["b1"] - stats["b0"], 1e-9)
    cell = extent / max(1.0, math.sqrt(n / max(k, 1)))
    grid = cents.select("key", "lat", "lon", F.floor(F.col("lat") / cell).alias("cx"),
                        F.floor(F.col("lon") / cell).alias("cy"))
    pending = grid.select(F.col("key").alias("target"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon"),
                          F.col("cx").alias("tcx"), F.col("cy").alias("tcy"))
    done = None
    radius = 1
    span_cells = extent / cell + 2
    while True:
        offs = F.sequence(F.lit(-radius), F.lit(radius))
        probe = pending.select("*", F.explode(offs).alias("dx")).select("*", F.explode(offs).alias("dy")) \
            .withColumns({"pcx": F.col("tcx") + F.col("dx"), "pcy": F.col("tcy") + F.col("dy")})
        cand = probe.join(grid, (F.col("pcx") == F.col("cx")) & (F.col("pcy") == F.col("cy"))) \
            .where(F.col("key") != F.col("target"))
        cand = cand.withColumn("dist", F.sqrt((F.col("lat") - F.col("tlat")) ** 2 + (F.col("lon") - F.col("tlon")) ** 2))
        w = Window.partitionBy("target").orderBy("dist", "key")
        top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
            .select("target", F.col("key").alias("neighbour"), "dist", "rank")
        final_all = radius >= span_cells
        kth = top.groupBy("target").agg(F.count(F.lit(1)).alias("m"), F.max("dist").alias("dk"))
        ok = kth.where(F.lit(final_all) | ((F.col("m") >= k) & (F.col("dk") <= radius * cell))).select("target")
        settled = cut_lineage(top.join(ok, "target", "left_semi"), "nearest")
        done = settled if done is None else done.unionByName(settled)
        if final_all:
            break
        pending = cut_lineage(pending.join(settled.select("target").distinct(), "target", "left_anti"), "pending")
        if pending.isEmpty():
            break
        radius *= 2
    return done


# --- J7 / A14: nearest in time -------------------------------------------------------------------------

def nearest_in_time(rows: DataFrame, targets: DataFrame, key: str, date_col: str, value: str,
                    seq_col: str) -> DataFrame:
    """Per (target, donor): the donor's value on the target date (last non-null in row
    order), else the non-null value with the smallest absolute date gap (ties: row order).

    ``targets`` has columns (target, donor, target_date); rows are the donors' rows.
    A donor is reduced to one row per date first (map-side combined); target and
    donor dates then meet in one ordered pass per donor, which carries the date
    before and the date after each target date.
    """
    r = rows.where(F.col(value).isNotNull() & F.col(date_col).isNotNull()).select(
        F.col(key).alias("donor"), F.col(date_col).alias("_d"), F.col(value).alias("_v"),
        F.col(seq_col).cast("long").alias("_s"))
    days = r.groupBy("donor", "_d").agg(F.min("_s").alias("s"), F.min_by("_v", "_s").alias("first"), F.max_by("_v", "_s").alias("last"))
    days = days.select("donor", "_d", F.struct(F.col("_d").alias("d"), "s", "first", "last").alias("day"))
    kind = days.schema["day"].dataType
    asked = targets.select("donor", F.col("target_date").alias("_d")).distinct().withColumn("day", F.lit(None).cast(kind))
    both = days.unionByName(asked)
    w = Window.partitionBy("donor").orderBy("_d", F.col("day").isNull())
    near = both.withColumns({
        "before": F.last("day", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.first("day", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where(F.col("day").isNull())
    gap = lambda c: F.abs(F.datediff(F.col(f"{c}.d"), F.col("_d")))
    back, on = gap("before"), gap("after")
    earlier = on.isNull() | (back < on) | ((back == on) & (F.col("before.s") < F.col("after.s")))
    found = near.select(F.col("donor").alias("_donor"), F.col("_d").alias("_date"),
                        F.when(back == 0, F.col("before.last")).when(earlier & back.isNotNull(), F.col("before.first"))
                        .otherwise(F.col("after.first")).alias(value), F.least(back, on).alias("date_gap"))
    return targets.join(found, (F.col("donor") == F.col("_donor")) & (F.col("target_date") == F.col("_date"))) \
        .where(F.col("date_gap").isNotNull()).select("target", "donor", value, "date_gap")


def global_median_or(df: DataFrame, value: str, default: float = 0.0) -> DataFrame:
    """One-row median of the present values, ``default`` when there are none."""
    return quantiles.medians(df.select(rules.to_number(value).alias(value)), [value]) \
        .select(F.coalesce(F.col(value), F.lit(float(default))).alias("fallback"))
