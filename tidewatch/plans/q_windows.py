"""Queries for the per-key selections (W3-W6) on the cleaned readings, keyed by station."""

from __future__ import annotations

from tidewatch.operators import timeseries
from tidewatch.plans import baseline
from tidewatch.plans.catalogue import register, round_doubles
from tidewatch.plans.oracle import statement

ORDER = ["date", "reading_id"]


def _clean(spark, sf):
    return baseline.fixture_clean(spark, sf).select(
        "station", "reading_id", "date", "precipitation", "soil_moisture")


@register("q_latest_row", statement("SELECT * FROM w_latest", "w_latest"))
def q_latest_row(spark, sf):
    """Latest reading per station."""
    return timeseries.latest_row(_clean(spark, sf), ["station"], ORDER).select("station", "reading_id", "date")


@register("q_first_row", statement("SELECT * FROM w_first", "w_first"))
def q_first_row(spark, sf):
    """First reading per station (dedup on a key subset)."""
    return timeseries.first_row(_clean(spark, sf), ["station"], ORDER).select("station", "reading_id", "date")


@register("q_top_row", statement(
    "SELECT station, reading_id, date, round(precipitation, 6) AS precipitation FROM w_top", "w_top"))
def q_top_row(spark, sf):
    """Wettest reading per station (ties: earliest), else its latest reading."""
    out = timeseries.top_row(_clean(spark, sf), ["station"], "precipitation", "date", "reading_id")
    return round_doubles(out.select("station", "reading_id", "date", "precipitation"))


@register("q_last_value", statement(
    "SELECT station, round(soil_moisture, 6) AS soil_moisture FROM w_last", "w_last"))
def q_last_value(spark, sf):
    """Last non-null soil moisture per station in date order."""
    return round_doubles(timeseries.last_value(_clean(spark, sf), ["station"], "soil_moisture", ORDER))
