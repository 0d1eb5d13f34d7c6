"""The exact operators where sizes, types and values are awkward."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import joins, metrics, quantiles, selection, splits, timeseries
from tidewatch.sources import store


def test_running_sum_over_slices_that_begin_with_nulls(spark):
    rows = [(i, "k", None if i % 2 == 0 else 2.0) for i in range(12)]
    out = timeseries.ordered_scan(spark.createDataFrame(rows, "id long, k string, v double"), ["k"], ["id"], [], [("v", [], "s")], partitions=5)
    got = {r.id: r.s for r in out.collect()}
    assert got == {i: (2.0 * ((i + 1) // 2) if i else None) for i in range(12)}


def test_wide_ids_keep_their_order(spark):
    base = 2 ** 60
    df = spark.createDataFrame([(dt.date(2024, 1, 1), base + i) for i in range(100)], "d date, id long")
    assert selection.kth_row(df, ["d", "id"], 80) == (dt.date(2024, 1, 1), base + 80)
    out = splits.chrono_split(df, ["d", "id"], 0.2)
    assert sorted(r.id - base for r in out.where("is_test").collect()) == list(range(80, 100))


@pytest.mark.parametrize("parts", [1, 50])
def test_quantiles_do_not_depend_on_partitions(spark, parts):
    rows = [(None, 1.0), ("a", float("nan")), ("a", 0.0), ("a", 3.0), ("a", float("inf")), ("b", None), ("c", float("-inf")), ("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(parts)
    got = {r.g: r.m for r in quantiles.quantile_table(df, {"m": ("x", 0.5)}, ["g"]).collect()}
    assert got == {"a": 3.0, "b": None, "c": float("-inf")}
    every = {r.g: r.m for r in quantiles.quantile_table(df, {"m": ("x", 0.5)}, ["g"], drop_null_keys=False).collect()}
    assert every == {**got, None: 1.0}
    assert quantiles.quantile_table(df.where("false"), {"m": ("x", 0.5)}).first().m is None


def test_clustered_scores(spark):
    rows = [(i, 0.5 + (i % 50) * 1e-9, int(i % 50 > 25)) for i in range(500)] + [(500, 1e9, 0)]
    df = spark.createDataFrame(rows, "id long, score double, label int")
    pos = [s for _, s, y in rows if y]
    neg = [s for _, s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(metrics.exact_auc(df).first().roc_auc - want) < 1e-12


def test_null_label_is_a_class(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 3 < 2 else None) for i in range(60)], "id long, y int")
    out = splits.stratified_split(df, "y", "id", 0.2)
    per = {r.y: (r.n, r.t) for r in out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert per == {0: (20, 4), 1: (20, 4), None: (20, 4)}


def test_repeated_dimension_key_raises_after_a_rewrite(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="dim-"), "d")
    fact = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    spark.createDataFrame([(1, "a"), (None, "x"), (None, "y")], "k int, v string").write.parquet(path)
    assert joins.join_dimension(fact, spark.read.parquet(path), ["k"]).count() == 3
    spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string").write.mode("overwrite").parquet(path)
    with pytest.raises(Exception, match="not unique"):
        joins.join_dimension(fact, spark.read.parquet(path), ["k"]).collect()


def test_prepared_tables_follow_their_input(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="in-"), "t")
    made = []

    def build():
        made.append(1)
        return spark.read.parquet(path)

    spark.range(3).write.parquet(path)
    assert store.once(spark, "t", [path], build).count() == store.once(spark, "t", [path], build).count() == 3
    spark.range(5).write.mode("overwrite").parquet(path)
    assert store.once(spark, "t", [path], build).count() == 5 and len(made) == 2
