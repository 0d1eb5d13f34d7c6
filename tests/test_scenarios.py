"""C3 / C4 on the derived readings (the reference's two table-job tests)."""

from pyspark.sql import functions as F

from tidewatch.plans import scenarios
from tidewatch.sources import fixture


def test_surge_adds_one_row_per_district(spark, sf_dir):
    raw = fixture.readings(spark, sf_dir)
    aug, audit = scenarios.surge(raw, ["AFRICA", "ASIA"])
    assert aug.count() == raw.count() + 2
    rows = audit.orderBy("scenario_date").collect()
    assert [r.district for r in rows] == ["AFRICA", "ASIA"]
    assert all(r.scenario_precipitation <= 500 for r in rows)
    assert rows[0].spike_multiplier_applied == 4.0


def test_surge_skips_unknown_district(spark, sf_dir):
    raw = fixture.readings(spark, sf_dir)
    aug, audit = scenarios.surge(raw, ["NOWHERE", "ASIA"])
    assert aug.count() == raw.count() + 1 and audit.count() == 1


def test_imputation_keeps_rows_and_uses_two_donors(spark, sf_dir):
    raw = fixture.readings(spark, sf_dir)
    upd, audit = scenarios.impute_faulty_sensor(raw, "ASIA")
    a = audit.first()
    assert a.faulty_district == "ASIA" and len(a.donor_districts) == 2 and len(a.donor_values) == 2
    assert upd.count() == raw.count()
    assert upd.where(F.col("district") == "ASIA").count() > 0


def test_imputation_unknown_district_is_unchanged(spark, sf_dir):
    raw = fixture.readings(spark, sf_dir)
    upd, audit = scenarios.impute_faulty_sensor(raw, "NOWHERE")
    assert audit is None and upd is raw


def test_sentinel_rain_is_no_donor_value(spark, sf_dir):
    raw = fixture.readings(spark, sf_dir).withColumn("precipitation", F.when(F.col("district") != "ASIA", F.lit("-999")).otherwise("4"))
    _, audit = scenarios.impute_faulty_sensor(raw, "ASIA")
    assert audit.first().imputed_precipitation == 4.0  # the median of what is known
    _, literal = scenarios.impute_faulty_sensor(raw, "ASIA", keep_sentinels=True)
    assert literal.first().imputed_precipitation == -999.0
