"""Edge semantics from the survey's traps."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import timeseries
from tidewatch.plans import scenarios

COLS = ("reading_id long, district string, date string, precipitation string, precip_3day_avg double, "
        "precip_7day_avg double, soil_moisture double, soil_3day_avg double, water_area_km2 double, "
        "water_area_change double, water_area_pct_change double, flood_event int")


def test_null_key_gets_null_lag_and_sum(spark):
    rows = [(1, "A", dt.date(2023, 1, 1), 1.0), (2, "A", dt.date(2023, 1, 2), 2.0),
            (3, None, dt.date(2023, 1, 1), 5.0), (4, None, dt.date(2023, 1, 2), 6.0)]
    df = spark.createDataFrame(rows, "id long, k string, d date, v double")
    for out in (timeseries.ordered_scan(df, ["k"], ["d", "id"], ["v"], [("v", [], "cum")], partitions=3),
                timeseries.running_sum(timeseries.lag_columns(df, ["v"], ["k"], ["d", "id"]), "v", ["k"],
                                       ["d", "id"], "cum")):
        got = {r.id: (r.v_lag1, r.cum) for r in out.collect()}
        assert got == {1: (None, 1.0), 2: (1.0, 3.0), 3: (None, None), 4: (None, None)}


def test_ordered_scan_spans_partitions(spark):
    rows = [(i, "HOT" if i % 3 else "cold", dt.date(2023, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, d date, v double")
    a = timeseries.ordered_scan(df, ["k"], ["d", "id"], ["v"], [("v", [], "cum")], partitions=7)
    b = timeseries.running_sum(timeseries.lag_columns(df, ["v"], ["k"], ["d", "id"]), "v", ["k"], ["d", "id"], "cum")
    ra = {r.id: (r.v_lag1, r.cum) for r in a.collect()}
    rb = {r.id: (r.v_lag1, r.cum) for r in b.collect()}
    assert ra == rb


def test_surge_fallbacks_and_clamps(spark):
    rows = [(1, "A", "1/5/2024", "", None, 12.0, None, 0.5, None, None, None, 0),
            (2, "A", "1/6/2024", "-3", 2.0, None, 0.95, None, 10.0, 1.0, 0.1, 0),
            (3, "B", "bad", "10", 1.0, 1.0, 0.1, 0.1, 1.0, 1.0, 1.0, 0)]
    raw = spark.createDataFrame(rows, COLS)
    aug, audit = scenarios.surge(raw, ["A", "B"], 300.0)
    a = audit.collect()
    assert len(a) == 1 and a[0].district == "A"  # B has no valid date: skipped, no offset used
    assert a[0].original_precipitation == 12.0     # rain <= 0 -> last valid 7-day average
    assert a[0].scenario_date == "1/7/2024"         # one day after the latest valid date
    new = aug.where(F.col("date") == "1/7/2024").first()
    assert new.soil_moisture == 1.0 and new.precip_3day_avg == min(500.0, 2.0 * 0.35 + 48.0 * 0.65)
    assert new.flood_event == 1 and new.water_area_change == 4.5


def test_surge_without_any_fallback_uses_fifty(spark):
    rows = [(1, "A", "3/1/2024", "", None, None, None, None, None, None, None, 0)]
    aug, audit = scenarios.surge(spark.createDataFrame(rows, COLS), ["A"], 300.0)
    r = audit.first()
    assert r.original_precipitation == 50.0 and r.scenario_precipitation == 200.0
    new = aug.where(F.col("date") == "3/2/2024").first()
    assert new.precip_3day_avg == 500.0 and new.soil_moisture == 1.0 and new.water_area_km2 == 0.0


def test_written_tables_are_dropped_alone(spark, tmp_path):
    from tidewatch.session import cut_lineage, drop_table
    from tidewatch.sources import store

    a, b = cut_lineage(spark.range(5), "a"), cut_lineage(spark.range(6), "b")
    path = a.inputFiles()[0]
    drop_table(a)
    assert not store.exists(spark, path) and b.count() == 6
    spark.range(3).write.parquet(str(tmp_path / "given"))
    given = spark.read.parquet(str(tmp_path / "given"))
    drop_table(given)  # not a table of this application
    assert given.count() == 3


def test_running_sum_with_extra_columns_out_of_order(spark):
    """Carries with more keys than ranges: the extra column does not rise with the order."""
    from tidewatch.operators import timeseries

    rows = [(i, i % 37, float(i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x long, v double").withColumn("k", F.lit(1))
    got = {r.id: r.s for r in timeseries.ordered_scan(df, ["k"], ["id"], [], [("v", ["x"], "s")]).collect()}
    total, want = {}, {}
    for i, x, v in rows:
        total[x] = total.get(x, 0.0) + v
        want[i] = total[x]
    assert got == want


def test_target_correlations_of_many_columns_in_long_form(spark):
    """As many columns as the model frame has: one short aggregate per column's rows, nulls and constants as before."""
    from pyspark.sql import functions as F

    from tidewatch.operators import audit

    df = spark.range(500).select(F.when(F.col("id") % 9 > 0, (F.col("id") % 5 == 0).cast("int")).alias("y"), F.lit(3).alias("same"),
                                 F.lit(None).cast("double").alias("none"),
                                 *[F.when((F.col("id") + i) % 13 > 0, (F.col("id") * (i + 3)) % 101).alias(f"c{i}") for i in range(30)])
    out = audit.target_correlations(df, "y", exclude=["c0"], top=40)
    got = [(r.feature, r.abs_corr) for r in out.collect()]
    want = {f"c{i}": df.agg(F.abs(F.corr(F.col(f"c{i}").cast("double"), F.col("y").cast("double")))).first()[0] for i in range(1, 30)}
    assert got[-2:] == [("none", None), ("same", None)] and len(got) == 31
    assert [v for _, v in got[:-2]] == sorted((v for _, v in got[:-2]), reverse=True)
    assert all(abs(want[c] - v) < 1e-9 for c, v in got[:-2])
    assert "Expand" in out._jdf.queryExecution().optimizedPlan().toString()
    flat = audit.target_correlations(df.withColumn("y", F.lit(1)), "y", top=40)
    assert {r.abs_corr for r in flat.collect()} == {None} and audit.target_correlations(df.limit(0), "y", top=40).count() == 32
