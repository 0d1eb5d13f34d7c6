"""Model frame and the scoring baselines (month medians, default row, terrain lookup)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators import lookups, quantiles
from tidewatch.plans import clean, scenarios
from tidewatch.session import cut_lineage
from tidewatch.sources import fixture, store


def model_frame(raw: DataFrame, terrain: DataFrame, opts: clean.CleanOptions | None = None) -> DataFrame:
    """C1 then J1: the cleaned readings with terrain attached.

    Written once (several baselines and fits read it) unless materialising is off.
    """
    opts = opts or clean.CleanOptions()
    out = lookups.attach_terrain(clean.clean_readings(raw, opts), terrain)
    return cut_lineage(out, "model-frame") if opts.materialize else out


def fixture_inputs(sf_dir: str) -> list[str]:
    """The driver tables the readings and dimensions are derived from."""
    return [f"{sf_dir}/{t}.parquet" for t in ("events", "region", "nation", "customer")]


def prepared_clean(spark: SparkSession, sf_dir: str, name: str, raw: Callable[[], DataFrame]) -> DataFrame:
    """C1 over ``raw()``: the ordered features and the lag medians are prepared once per application and input;
    readers fill the lags, so the filled rows are not written a second time."""
    inputs = fixture_inputs(sf_dir)
    lagged = store.once(spark, name, inputs, lambda: clean.lagged_readings(raw()))
    lags = clean.lagged_columns(lagged)
    medians = store.once(spark, f"{name}-medians", inputs, lambda: quantiles.medians(lagged, lags))
    return quantiles.fill_with_medians(lagged, lags, found=medians)


def fixture_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 over the derived readings, prepared once per application and input."""
    return prepared_clean(spark, sf_dir, "clean", lambda: fixture.readings(spark, sf_dir))


def fixture_model_frame(spark: SparkSession, sf_dir: str, short_terrain: bool = False) -> DataFrame:
    """J1 on the prepared C1 table."""
    return lookups.attach_terrain(fixture_clean(spark, sf_dir), fixture.terrain(spark, sf_dir, short_terrain))


def fixture_audit_raw(spark: SparkSession, sf_dir: str, faulty: str, impacted: list[str]) -> DataFrame:
    """C9's raw table: the derived readings after C4 and C3, prepared once per application and input."""
    def build():
        updated, _ = scenarios.impute_faulty_sensor(fixture.readings(spark, sf_dir), faulty)
        return scenarios.surge(updated, impacted)[0]

    return store.once(spark, "-".join(["audit-raw", faulty, *impacted]).replace(" ", "_"), fixture_inputs(sf_dir), build)


def fixture_audit_clean(spark: SparkSession, sf_dir: str, faulty: str, impacted: list[str]) -> DataFrame:
    """C1 over C9's raw table, prepared once per application and input."""
    return prepared_clean(spark, sf_dir, "-".join(["audit-clean", faulty, *impacted]).replace(" ", "_"),
                          lambda: fixture_audit_raw(spark, sf_dir, faulty, impacted))


def fixture_audit_frame(spark: SparkSession, sf_dir: str, faulty: str, impacted: list[str]) -> DataFrame:
    """J1 on C9's cleaned table."""
    return lookups.attach_terrain(fixture_audit_clean(spark, sf_dir, faulty, impacted), fixture.terrain(spark, sf_dir))


@dataclass
class Baseline:
    month: DataFrame      # (district, month) -> medians
    default: DataFrame    # one row of global medians
    terrain: DataFrame    # district -> (terrain_type, avg_elevation_m)
    allowed: DataFrame    # known districts


def build_baseline(model_df: DataFrame, terrain: DataFrame, order_cols: list[str] = ("date", "reading_id"),
                   method: str = "exact") -> Baseline:
    """A1 + A2 + W5/J4 + U2 as four flat tables."""
    return Baseline(
        month=lookups.month_baseline(model_df, method=method),
        default=lookups.default_baseline(model_df, method=method),
        terrain=lookups.terrain_lookup(model_df, terrain, list(order_cols)),
        allowed=lookups.allowed_districts(model_df, terrain),
    )


def fixture_baseline(spark: SparkSession, sf_dir: str) -> Baseline:
    """C2 over the derived readings; the median tables are prepared once per application and input."""
    frame, terrain = fixture_model_frame(spark, sf_dir), fixture.terrain(spark, sf_dir)
    inputs = fixture_inputs(sf_dir)
    return Baseline(
        month=store.once(spark, "month-baseline", inputs, lambda: lookups.month_baseline(frame)),
        default=store.once(spark, "default-baseline", inputs, lambda: lookups.default_baseline(frame)),
        terrain=lookups.terrain_lookup(frame, terrain, ["date", "reading_id"]),
        allowed=lookups.allowed_districts(frame, terrain),
    )
