"""C8 end to end on the small tables, artifacts written and read back (S3-S6), CSV source."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from tidewatch.operators import learn, lookups
from tidewatch.plans import clean, scoring, training
from tidewatch.sources import fixture, tables

TINY = [learn.ModelSpec("random_forest", trees=4, max_depth=4), learn.ModelSpec("gradient_boosted", boost_rounds=10, boost_depth=2)]


def _exposure(spark, sf):
    return scoring.Exposure(fixture.district_regions(spark, sf), fixture.region_divisors(spark, sf),
                            fixture.risk_profiles(spark, sf),
                            lookups.region_population(fixture.impact_reports(spark, sf)))


def test_training_run_and_artifacts(spark, sf_dir):
    opts = training.TrainOptions(candidates=TINY, folds=2, faulty_district="ASIA", surge_districts=["AFRICA", "ASIA"])
    result = training.train_and_evaluate(fixture.readings(spark, sf_dir), fixture.terrain(spark, sf_dir),
                                         _exposure(spark, sf_dir), opts)
    assert result["selected_model"] in ("random_forest", "gradient_boosted")
    card = result["scorecard"].collect()
    assert {r.split for r in card} == {"year_holdout", "timeseries_cv"} and len(card) == 4
    audit = result["stress_audit"].collect()
    assert audit and all(r.risk_level_en == "Critical" for r in audit)  # 500 mm, saturated, water visible
    out = tempfile.mkdtemp(prefix="tidewatch-artifacts-")
    training.save_artifacts(result, out)
    raw = fixture.readings(spark, sf_dir).count()
    assert spark.read.parquet(os.path.join(out, "readings_imputed")).count() == raw
    assert spark.read.parquet(os.path.join(out, "readings_augmented")).count() == raw + 2  # one surge row a district
    meta = json.load(open(os.path.join(out, "model_meta.json")))
    assert meta["selected_model"] == result["selected_model"]
    assert spark.read.parquet(os.path.join(out, "region_population")).count() > 0
    model, saved = tables.load_artifacts(spark, out)
    base = training.baseline_from_artifacts(saved)
    scored = scoring.score_reports(fixture.field_reports(spark, sf_dir).drop("score"), base,
                                   _exposure(spark, sf_dir), model=model)
    assert scored.count() == fixture.field_reports(spark, sf_dir).count()
    assert scored.where(F.col("ok") & F.col("risk_level_en").isNull()).count() == 0


def test_csv_source_cleans_like_parquet(spark, sf_dir):
    raw = fixture.readings(spark, sf_dir)
    path = os.path.join(tempfile.mkdtemp(prefix="tidewatch-csv-"), "readings")
    tables.write_table(raw, path, fmt="csv")
    text = tables.read_csv_as_strings(spark, path, raw.columns)
    assert all(t == "string" for _, t in text.dtypes)
    a = clean.quality_counters(text).first().asDict()
    b = clean.quality_counters(raw).first().asDict()
    assert a == b


def test_leaderboard_on_latest_rows(spark, sf_dir):
    frame, _ = training.prepare(fixture.readings(spark, sf_dir), fixture.terrain(spark, sf_dir),
                                training.TrainOptions())
    model = learn.fit(frame, learn.Features(), TINY[0])
    prepared = training.latest_per_district(frame).drop("rain_soil_interaction", "monsoon_cumulative_precip",
                                                        "avg_elevation_m", "terrain_type")
    board = training.leaderboard(prepared, model, "team", "institute", "2026-05-09 11:13:15").collect()
    assert board and all(r.risk_level in ("Low", "Medium", "High", "Critical") for r in board)
    assert all(0.0 <= r.confidence_pct <= 100.0 for r in board)
    assert board[0].top_feature and not board[0].top_feature.startswith(("num__", "cat__"))
