"""Learning operators on the small tables: shapes and ranges (no digit-level twin exists)."""

from pyspark.sql import functions as F

from tidewatch.operators import forest, learn, metrics, splits
from tidewatch.plans import baseline, clean, q_audit, q_learn, scenarios, training
from tidewatch.plans.oracle import FAULTY_DISTRICT, SURGE_DISTRICTS
from tidewatch.sources import fixture

TINY = learn.ModelSpec("random_forest", trees=5, max_depth=5)


def test_fit_predict_and_importance(spark, sf_dir):
    frame, notes = training.prepare(fixture.readings(spark, sf_dir), fixture.terrain(spark, sf_dir),
                                    training.TrainOptions())
    assert "water_area_km2" in notes["excluded_features"]
    model = learn.fit(frame, learn.Features(), TINY)
    scored = learn.predict(model, frame)
    assert scored.count() == frame.count()
    assert scored.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    imp = learn.feature_importance(model).collect()
    assert imp[0].feature.startswith(("num__", "cat__"))
    assert abs(sum(r.importance for r in imp) - 1.0) < 1e-6


def test_unseen_category_is_all_zeros(spark, sf_dir):
    frame, _ = training.prepare(fixture.readings(spark, sf_dir), fixture.terrain(spark, sf_dir),
                                training.TrainOptions())
    model = learn.fit(frame, learn.Features(), TINY)
    odd = frame.limit(3).withColumn("district", F.lit("ATLANTIS"))
    assert learn.predict(model, odd).count() == 3


def test_permuted_keeps_values(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 17).alias("x"))
    p = learn.permuted(df, "x", 3, id_col="id")
    a = sorted(r.x for r in df.collect()) * 3
    assert sorted(r.x for r in p.collect()) == sorted(a)


def test_permutation_depends_on_ids_alone(spark):
    df = spark.range(200).select("id", (F.col("id") % 17).alias("x"))
    one, many = (sorted(tuple(r) for r in learn.permuted(df.repartition(n), "x", 2, id_col="id").collect()) for n in (1, 50))
    assert one == many and sum(x != i % 17 for i, x, _ in one) > 300


def test_registered_queries_fit_the_reference_settings(spark, sf_dir):
    """The stored model of q_train_score and q_extra_trees has the source's trees, all of them."""
    for spec, name in ((q_learn.FOREST, "random_forest"), (q_learn.EXTRA, "extra_trees")):
        assert (spec.name, spec.trees, spec.min_leaf, spec.balanced, spec.max_depth) == (name, 500, 2, True, 30)
    n = q_learn._frame(spark, sf_dir).count()
    for query, spec in ((q_learn.q_train_score, q_learn.FOREST), (q_learn.q_extra_trees, q_learn.EXTRA)):
        rows = query(spark, sf_dir).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 and r.prediction == (r.score > 0.5) for r in rows)
        model = q_learn._model(spark, sf_dir, spec)
        assert model.spec == spec and model.nodes.select("tree").distinct().count() == 500
        auc = metrics.exact_auc(query(spark, sf_dir)).first().roc_auc
        assert auc > 0.9  # on rows the trees have seen


def test_audit_runs_after_the_scenario_edits(spark, sf_dir, monkeypatch):
    raw = fixture.readings(spark, sf_dir)
    edited, _ = scenarios.surge(scenarios.impute_faulty_sensor(raw, FAULTY_DISTRICT)[0], SURGE_DISTRICTS)
    cleaned = clean.clean_readings(edited)
    seen = []
    monkeypatch.setattr(training, "ablation", lambda frame, *_: seen.append(frame) or frame.limit(0))
    q_learn.q_ablation(spark, sf_dir)
    found = {r.reading_id: r.date for r in seen[0].groupBy("reading_id").agg(F.max("date").alias("date")).collect()}
    assert found == {r.reading_id: r.date for r in cleaned.groupBy("reading_id").agg(F.max("date").alias("date")).collect()}
    one = q_audit.q_leakage_summary_scenarios(spark, sf_dir).first()
    assert one.rows_before == raw.count() + len(SURGE_DISTRICTS) and one.rows_after == cleaned.count()
    rate = cleaned.agg(F.avg(F.col("flood_event").cast("double"))).first()[0]
    assert abs(one.flood_event_rate - rate) < 1e-5
    assert q_audit.q_target_correlation_scenarios(spark, sf_dir).count() == 12


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_permutation_importance_leaves_no_tables_and_is_that_of_all_columns_at_once(spark):
    import os

    from tidewatch.session import checkpoint_dir

    df = spark.range(400).select(F.col("id").alias("reading_id"), (F.col("id") % 3 == 0).cast("int").alias("label"),
                                 (F.col("id") % 7 + (F.col("id") % 3)).cast("double").alias("a"),
                                 F.when(F.col("id") % 11 > 0, (F.col("id") % 11).cast("int")).alias("b"), F.concat(F.lit("t"), F.col("id") % 4).alias("c"))
    model = learn.fit(df, learn.Features(["a", "b"], ["c"]), TINY)
    model.trees
    folder = f"{checkpoint_dir(spark)}/tidewatch/{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder))
    got = {r.feature: (r.importance_mean, r.importance_std) for r in learn.permutation_importance(model, df, ["a", "b", "c"], 3).collect()}
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("permuted-test-")
    base = learn.predict(model, df).where("label = prediction").count() / 400
    moved = learn.permuted_values(df, ["a", "b", "c"], 3)
    for c in ("a", "b", "c"):
        mine = moved.where(F.col("feature") == c).select(F.col("id").alias("reading_id"), "repeat", F.col("text" if c == "c" else "number").alias("_new"))
        rows = mine.join(df, "reading_id").withColumn(c, F.col("_new").cast(df.schema[c].dataType))
        acc = [r.a for r in learn.predict(model, rows).groupBy("repeat").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a")).collect()]
        assert len(acc) == 3 and abs(got[c][0] - (base - sum(acc) / 3)) < 1e-12


def test_bootstrap_filter_makes_the_digest_once(spark):
    counted = forest.bootstrap_counts(spark.range(50).select("id"), 4, 42).where("times > 0")
    assert _plan(counted).count("md5(") == 1


def test_stratified_cuts_are_broadcast(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).alias("label"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = splits.stratified_split(df, "label", "id")
        text = out._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    first = next(line for line in text.splitlines() if "Join" in line)
    assert "BroadcastHashJoin" in first and out.where("is_test").count() == 40
