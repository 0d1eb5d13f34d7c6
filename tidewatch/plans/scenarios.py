"""Table-editing scenarios on raw readings.

C3 appends one stress row per impacted district (its wettest valid-date row,
rain scaled and capped, dependants adjusted, dated after the data).  C4
replaces the latest rain reading of one district by the mean of its two
nearest districts' readings nearest in time.  Both work on whole tables with
aggregates (``max_by`` / ``min_by``) and broadcast joins of bounded tables
(the impacted-district list is the caller's parameter; donors are two rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import fixed, rules
from tidewatch.operators import lookups, timeseries
from tidewatch.session import cut_lineage


def _cast_like(expr: Column, dtype: str) -> Column:
    return expr.cast(dtype)


def surge(raw: DataFrame, districts: list[str] = tuple(fixed.SURGE_DEFAULT_DISTRICTS),
          increase_pct: float = fixed.SURGE_DEFAULT_PCT, seq_col: str = "reading_id",
          date_col: str = "date") -> tuple[DataFrame, DataFrame]:
    """(augmented table, audit table).

    A district without a valid-date row is skipped and takes no day offset; the
    i-th injected row is dated i days after the latest valid date (2024-12-31 if none).
    """
    spark = raw.sparkSession
    factor = 1.0 + increase_pct / 100.0
    types = dict(raw.dtypes)
    parsed = raw.withColumn("_d", rules.parse_date(date_col)).withColumn("_p", rules.to_number("precipitation"))
    last = parsed.agg(F.coalesce(F.max("_d"), F.lit(fixed.SURGE_DEFAULT_LAST_DATE).cast("date")).alias("_last"))
    impacted = spark.createDataFrame([(d, i) for i, d in enumerate(districts)], "district string, _pos int")
    valid = parsed.where(F.col("_d").isNotNull()).join(F.broadcast(impacted), "district")
    source = timeseries.top_row(valid, ["district"], "_p", "_d", seq_col)
    p7 = timeseries.last_value(valid.withColumn("_p7", rules.to_number("precip_7day_avg")), ["district"], "_p7",
                               ["_d", seq_col], "_fallback7")
    # one row per impacted district at most (bounded by the parameter list)
    src = source.join(p7, "district", "left").crossJoin(F.broadcast(last))
    src = src.withColumn("_offset", F.row_number().over(Window.orderBy("_pos")))
    orig = F.when(F.col("_p") > 0, F.col("_p")).otherwise(F.coalesce(F.col("_fallback7"),
                                                                      F.lit(fixed.SURGE_RAIN_FALLBACK)))
    src = src.withColumn("_orig", orig).withColumn("_new", F.least(F.lit(500.0), F.col("_orig") * factor))
    src = src.withColumn("_sdate", F.date_add(F.col("_last"), F.col("_offset")))
    num = rules.to_number
    km2 = F.greatest(F.lit(0.0), num("water_area_km2") * 1.45)
    change = F.greatest(F.lit(1.0), num("water_area_change") + 3.5)
    changes = {
        "precipitation": F.col("_new"),
        "precip_3day_avg": F.least(F.lit(500.0), num("precip_3day_avg") * 0.35 + F.col("_new") * 0.65),
        "precip_7day_avg": F.least(F.lit(500.0), num("precip_7day_avg") * 0.55 + F.col("_new") * 0.45),
        "soil_moisture": F.least(F.lit(1.0), num("soil_moisture") + 0.12),
        "soil_3day_avg": F.least(F.lit(1.0), num("soil_3day_avg") + 0.08),
        "water_area_km2": km2,
        "water_area_change": change,
        "water_area_pct_change": change / F.greatest(km2 - change, F.lit(fixed.PCT_CHANGE_FLOOR)),
        "flood_event": F.lit(1),
        date_col: rules.mdy("_sdate"),
    }
    new_rows = src.select(*[_cast_like(changes[c], types[c]).alias(c) if c in changes else F.col(c)
                            for c in raw.columns])
    audit = src.select(
        "district",
        rules.mdy("_d").alias("original_date"),
        rules.mdy("_sdate").alias("scenario_date"),
        F.bround("_orig", 3).alias("original_precipitation"),
        F.bround("_new", 3).alias("scenario_precipitation"),
        F.bround(F.lit(factor), 3).alias("spike_multiplier_applied"),
    )
    return raw.unionByName(new_rows), audit


def impute_faulty_sensor(raw: DataFrame, district: str = fixed.IMPUTE_DEFAULT_DISTRICT,
                         seq_col: str = "reading_id", date_col: str = "date",
                         donors: int = fixed.IMPUTE_DONORS,
                         keep_sentinels: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """C4: (updated table, one-row audit) or (table unchanged, None) when impossible.

    Target: the district's latest valid-date row.  Donors: the two nearest other
    districts by centroid (ties by name).  Each donor gives its rain on the
    target date (last in row order) or nearest in time; missing donors are the
    global median rain (0 if none).  Rolling rain columns are blended.  The
    sentinel rain value is missing, unless ``keep_sentinels`` takes it literally.
    """
    rain = rules.to_number("precipitation")
    rain = rain if keep_sentinels else rules.sentinel_to_null(rain)
    types = dict(raw.dtypes)
    parsed = raw.withColumn("_d", rules.parse_date(date_col))
    target = parsed.where((F.col("district") == district) & F.col("_d").isNotNull()) \
        .groupBy().agg(F.max_by(F.struct("_d", seq_col, rules.to_number("precipitation").alias("_p")),
                                F.struct("_d", seq_col)).alias("t")).first()["t"]
    if target is None:
        return raw, None
    tdate, tseq, tprec = target["_d"], target[seq_col], target["_p"]
    cents = lookups.centroids(raw)
    nn = lookups.nearest_to_one(cents, district, donors).collect()  # <= donors rows
    if len(nn) < donors:
        return raw, None
    nn = sorted(nn, key=lambda r: r["rank"])
    targets = raw.sparkSession.createDataFrame(
        [(district, r["neighbour"], tdate) for r in nn], "target string, donor string, target_date date")
    rows = parsed.select("district", seq_col, F.col("_d"), rain.alias("precipitation"))
    vals = {r["donor"]: r["precipitation"] for r in
            lookups.nearest_in_time(rows, targets, "district", "_d", "precipitation", seq_col).collect()}
    values = [vals[r["neighbour"]] for r in nn if r["neighbour"] in vals]
    if len(values) < donors:
        fallback = lookups.global_median_or(raw.select(rain.alias("precipitation")), "precipitation").first()["fallback"]
        values += [fallback] * (donors - len(values))
    imputed = float(sum(values[:donors]) / donors)

    match = F.coalesce((F.col("district") == district) & (F.col("_d") == F.lit(tdate))
                       & (F.col(seq_col) == F.lit(tseq)), F.lit(False))
    rest = parsed.where(~match).drop("_d")
    # exact copies of the target row: change exactly one of them; ids are taken
    # on a checkpointed copy so a recomputed task cannot move them
    copies = cut_lineage(parsed.where(match).drop("_d")).withColumn("_cid", F.monotonically_increasing_id())
    first_id = copies.agg(F.min("_cid").alias("_first"))
    copies = copies.crossJoin(F.broadcast(first_id))
    pick = F.col("_cid") == F.col("_first")
    changes = {"precipitation": F.lit(imputed)}
    for c, alpha in fixed.IMPUTE_BLEND.items():
        changes[c] = rules.blend(F.lit(imputed), rules.to_number(c), alpha)
    edited = copies.select(*[F.when(pick, changes[c].cast(types[c])).otherwise(F.col(c)).alias(c)
                             if c in changes else F.col(c) for c in raw.columns])
    spark = raw.sparkSession
    audit = spark.createDataFrame(
        [(district, f"{tdate.month}/{tdate.day}/{tdate.year}", tprec, imputed,
          [r["neighbour"] for r in nn], [float(v) for v in values[:donors]])],
        "faulty_district string, faulty_date string, original_precipitation double, imputed_precipitation double, "
        "donor_districts array<string>, donor_values array<double>")
    audit = audit.withColumns({"imputed_precipitation": F.bround("imputed_precipitation", 3),
                               "donor_values": F.transform("donor_values", lambda v: F.bround(v, 3))})
    return rest.unionByName(edited), audit
