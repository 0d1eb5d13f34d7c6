"""Clean raw readings and derive the ordered features.

Plan shape: scan -> one narrow cleaning stage (parse, coerce, null rules,
range filter) -> dedup aggregate (shuffle on all columns, map-side combined)
-> window stage keyed by the entity (lag and running sum share one sort when
the keys agree) -> two global one-row aggregates (winsor bounds, lag medians)
broadcast back.  Quality counters are one aggregate over flag columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed, rules
from tidewatch.operators import quality, quantiles, timeseries
from tidewatch.session import cut_lineage


@dataclass
class CleanOptions:
    entity: str = "district"           # lag / running-sum key
    date_col: str = "date"
    seq_col: str | None = "reading_id"  # unique tie-breaker; None -> all columns
    bounds: dict = None
    winsor_column: str = "water_area_pct_change"
    quantile_method: str = "exact"
    materialize: bool = True           # write intermediate tables instead of recomputing them
    scan: str = "range"                # ordered scan over range partitions; "window": plain per-key windows

    def __post_init__(self):
        if self.bounds is None:
            self.bounds = dict(fixed.OUTLIER_BOUNDS)


def staged(df: DataFrame, opts: CleanOptions | None = None) -> DataFrame:
    """Parse / coerce / null rules on every raw row, with the rule flags as columns.

    Flags: ``_date_ok``, ``_phantom``.  Rows are not yet filtered.
    """
    opts = opts or CleanOptions()
    out = quality.parse_dates(df, opts.date_col)
    out = quality.coerce_numeric(out)
    if "precipitation" in out.columns:
        out = quality.null_sentinel(out, "precipitation")
    if "water_area_pct_change" in out.columns:
        out = quality.null_infinite(out, "water_area_pct_change")
    # text is parsed once: the flags and the filter on them read the values
    out = quality.once_per_row(out, [opts.date_col] + [c for c in fixed.NUMERIC_COLUMNS if c in out.columns and c != opts.date_col])
    return out.withColumns({
        "_date_ok": F.col(opts.date_col).isNotNull(),
        "_phantom": quality.phantom_flag(out, opts.bounds),
    })


def filtered(df: DataFrame, opts: CleanOptions | None = None) -> DataFrame:
    """Rows surviving the date rule, the range rule and exact dedup."""
    opts = opts or CleanOptions()
    s = staged(df, opts)
    kept = s.where(F.col("_date_ok") & ~F.col("_phantom")).drop("_date_ok", "_phantom")
    return quality.exact_dedup(kept)


def order_columns(df: DataFrame, opts: CleanOptions) -> list[str]:
    if opts.seq_col:
        return [opts.date_col, opts.seq_col]
    # after exact dedup rows are distinct, so all columns make a total order
    return [opts.date_col] + [c for c in df.columns if c != opts.date_col]


def lagged_columns(df: DataFrame) -> list[str]:
    return [c for c in (f"{s}_lag1" for s in fixed.LAG_COLUMNS) if c in df.columns]


def lagged_readings(df: DataFrame, opts: CleanOptions | None = None) -> DataFrame:
    """C1 up to the ordered features; the lags are not yet filled."""
    opts = opts or CleanOptions()
    out = timeseries.add_calendar(filtered(df, opts), opts.date_col)
    if opts.materialize:
        # the winsor bounds and the windows both read this table: compute it once
        out = cut_lineage(out, "clean-kept")
    if opts.winsor_column in out.columns:
        out = quantiles.winsorize(out, opts.winsor_column, fixed.WINSOR_LOW, fixed.WINSOR_HIGH,
                                  opts.quantile_method)
    order = order_columns(out, opts)
    out = out.withColumns({
        "rain_soil_interaction": rules.rain_soil_interaction("precipitation", "soil_moisture"),
        "_monsoon_rain": rules.seasonal_rain("is_monsoon", "precipitation"),
    })
    lag_sources = [c for c in fixed.LAG_COLUMNS if c in out.columns]
    if opts.scan == "range":
        out = timeseries.ordered_scan(out, [opts.entity], order, lag_sources,
                                      [("_monsoon_rain", ["year"], "monsoon_cumulative_precip")])
    else:
        out = timeseries.running_sum(out, "_monsoon_rain", [opts.entity, "year"], order,
                                     "monsoon_cumulative_precip")
        out = timeseries.lag_columns(out, lag_sources, [opts.entity], order)
    return out.drop("_monsoon_rain")


def clean_readings(df: DataFrame, opts: CleanOptions | None = None) -> DataFrame:
    """The cleaned, feature-complete table (rows in no particular order)."""
    opts = opts or CleanOptions()
    out = lagged_readings(df, opts)
    if opts.materialize:
        # the lag medians and the fill both read the windowed table
        out = cut_lineage(out, "clean-lagged")
    return quantiles.fill_with_medians(out, lagged_columns(out), opts.quantile_method)


def quality_counters(raw: DataFrame, cleaned: DataFrame | None = None, opts: CleanOptions | None = None) -> DataFrame:
    """The seven counters of a cleaning run as one row (BIGINT each).

    One aggregate over the staged flags plus the row count of the kept rows.
    """
    opts = opts or CleanOptions()
    s = staged(raw, opts)
    ok = F.col("_date_ok")
    flags = s.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(~ok).alias("bad_date_rows_removed"),
        F.count_if(ok & F.col("precipitation").isNull()).alias("precipitation_missing_count")
        if "precipitation" in s.columns else F.lit(0).cast("long").alias("precipitation_missing_count"),
        F.count_if(ok & F.col("water_area_pct_change").isNull()).alias("water_pct_non_finite_count")
        if "water_area_pct_change" in s.columns else F.lit(0).cast("long").alias("water_pct_non_finite_count"),
        F.count_if(ok & F.col("_phantom")).alias("phantom_rows_removed"),
    )
    kept = (cleaned if cleaned is not None else filtered(raw, opts)).agg(F.count(F.lit(1)).alias("rows_after"))
    out = flags.crossJoin(kept)
    return out.select(
        F.col("rows_before").cast("long"),
        F.col("rows_after").cast("long"),
        (F.col("rows_before") - F.col("bad_date_rows_removed") - F.col("phantom_rows_removed")
         - F.col("rows_after")).cast("long").alias("duplicates_removed"),
        F.col("phantom_rows_removed").cast("long"),
        F.col("bad_date_rows_removed").cast("long"),
        F.col("precipitation_missing_count").cast("long"),
        F.col("water_pct_non_finite_count").cast("long"),
    )
