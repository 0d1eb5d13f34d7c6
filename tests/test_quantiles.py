"""The ranked quantiles agree with Spark's exact percentile and with numpy."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import quantiles
from tidewatch.plans import clean
from tidewatch.sources import fixture


def test_selected_matches_percentile_and_numpy(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", "c"]) if i % 50 else None,
             rnd.choice([1.0, 2.0, 2.0, None, rnd.random() * 100]), float(i % 7)) for i in range(6000)]
    rows += [("d", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    specs = {"x_med": ("x", 0.5), "x_01": ("x", 0.01), "y_99": ("y", 0.99), "x_99": ("x", 0.99)}
    a = quantiles.quantile_table(df, specs, ["g"]).orderBy("g").collect()
    b = df.dropna(subset=["g"]).groupBy("g").agg(*[F.percentile(c, p).alias(n) for n, (c, p) in specs.items()]).orderBy("g").collect()
    assert len(a) == len(b) == 4
    for r1, r2 in zip(a, b):
        for k in specs:
            assert (r1[k] is None and r2[k] is None) or abs(r1[k] - r2[k]) < 1e-9
    g = quantiles.quantile_table(df, specs).first()
    vals = np.array([r[1] for r in rows if r[1] is not None])
    assert abs(g["x_med"] - np.quantile(vals, 0.5)) < 1e-12
    assert abs(g["x_01"] - np.quantile(vals, 0.01)) < 1e-12


def test_range_scan_equals_windows(spark, sf_dir):
    raw = fixture.readings(spark, sf_dir)
    cols = ["reading_id", "monsoon_cumulative_precip", "water_area_km2_lag1", "water_area_change_lag1",
            "water_area_pct_change_lag1"]
    a = clean.clean_readings(raw, clean.CleanOptions(scan="range")).select(*cols)
    b = clean.clean_readings(raw, clean.CleanOptions(scan="window")).select(*cols)
    ra = {r[0]: r for r in a.collect()}
    rb = {r[0]: r for r in b.collect()}
    assert ra.keys() == rb.keys()
    for k in ra:
        for x, y in zip(ra[k][1:], rb[k][1:]):
            assert (x is None and y is None) or abs(x - y) < 1e-9


def test_brackets_of_large_groups_hold_every_quantile(spark):
    """Groups beyond the sketch's accuracy, with ties, infinities, NaN and nulls, against sorted lists."""
    import math
    import random

    from tidewatch.operators import quantiles

    rng = random.Random(8)
    rows = []
    for i in range(9000):
        g = rng.choice([None, "a", "b", "b", "b"])
        x = rng.choice([0.0, 0.0, round(rng.gauss(0, 5), 1), rng.expovariate(0.01), float("inf"), float("-inf"), float("nan"), None])
        rows.append((g, x, float(i)))
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(9)
    shares = [0.0, 0.003, 0.25, 0.5, 0.77, 0.997, 1.0]
    specs = {f"{c}{j}": (c, p) for c in "xy" for j, p in enumerate(shares)}

    def want(values, p):
        v = sorted(values)
        k = p * (len(v) - 1)
        lo, hi, t = v[math.floor(k)], v[math.ceil(k)], k - math.floor(k)
        if lo == hi or t == 0 or lo == -math.inf:
            return lo
        return hi if hi == math.inf else lo + (hi - lo) * t

    for groups in (["g"], []):
        for r in quantiles.quantile_table(df, specs, groups, drop_null_keys=False).collect():
            for name, (c, p) in specs.items():
                mine = [row["xy".index(c) + 1] for row in rows if not groups or row[0] == r.g]
                mine = [v for v in mine if v is not None and not math.isnan(v)]
                assert len(mine) > quantiles.BRACKET and abs(r[name] - want(mine, p)) < 1e-9 or r[name] == want(mine, p), (name, p)


def test_bracket_values_are_found_in_long_form(spark, monkeypatch):
    """No condition per column side by side: with many columns such a method was too long to compile."""
    from tidewatch.operators import selection

    seen, ranks = [], selection.value_ranks
    monkeypatch.setattr(selection, "value_ranks", lambda df, *a: seen.append(df) or ranks(df, *a))
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), *[((F.col("id") * (7 + i)) % 997).cast("double").alias(f"c{i}") for i in range(20)])
    rows = quantiles.medians(df, [f"c{i}" for i in range(20)], ["g"]).collect()
    exact = df.groupBy("g").agg(*[F.expr(f"percentile(c{i}, 0.5)").alias(f"c{i}") for i in range(20)]).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, exact))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" in plan and "filter(array" not in plan


def test_values_meet_their_brackets_in_one_pass(spark, monkeypatch):
    """Values below a bracket are counted in the pass that finds those inside, by a number and not by the group's columns."""
    from tidewatch.operators import selection

    written, seen, ranks, write = [], [], selection.value_ranks, quantiles.cut_lineage
    monkeypatch.setattr(quantiles, "cut_lineage", lambda df, name: written.append(name) or write(df, name))
    monkeypatch.setattr(selection, "value_ranks", lambda df, *a: seen.append((df.columns, a)) or ranks(df, *a))
    df = spark.range(4000).select(F.when(F.col("id") % 4 != 0, (F.col("id") % 4).cast("string")).alias("g"), (F.col("id") * 7 % 1999).cast("double").alias("x"))
    got = quantiles.quantile_table(df, {"a": ("x", 0.5), "b": ("x", 0.01)}, ["g"], drop_null_keys=False).collect()
    want = df.groupBy("g").agg(F.percentile("x", 0.5).alias("a"), F.percentile("x", 0.01).alias("b")).collect()
    near = lambda rows: sorted((str(r.g), round(r.a, 9), round(r.b, 9)) for r in rows)
    assert near(got) == near(want)
    assert written == ["brackets"] and "g" not in seen[0][0]


def test_text_is_parsed_once_per_row(spark, sf_dir):
    """The filter on the flags reads the parsed values: below the projection it parsed the text again for every rule."""
    plan = clean.filtered(fixture.readings(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp(") == 1
    assert all("cast(value" not in line for line in plan.splitlines() if "Filter (" in line)


def test_prepared_readings_are_the_cleaned_readings(spark, sf_dir):
    """The lags are filled on reading; the rows are those of C1 and are written once, unfilled."""
    from tidewatch.plans import baseline
    from tidewatch.plans.catalogue import round_doubles

    ready = baseline.fixture_clean(spark, sf_dir)
    plain = round_doubles(clean.clean_readings(fixture.readings(spark, sf_dir)).select(*ready.columns))
    rows = round_doubles(ready)  # running sums differ in their last digits with the sampled ranges
    assert rows.exceptAll(plain).isEmpty() and plain.exceptAll(rows).isEmpty()
    assert any(f.split("/")[-2].startswith("clean-medians-") for f in ready.inputFiles())
