"""Golden values of the scalar rules (bands, validation, override, people at risk, text)."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.functions import fixed, rules
from tidewatch.operators import lookups


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_risk_band_closed_upper_edges(spark):
    probs = [0.00, 0.2499, 0.25, 0.50, 0.5001, 0.75, 0.7501]
    got = _one(spark, [(p,) for p in probs], "p double", rules.risk_band("p"))
    assert got == ["Low", "Low", "Medium", "Medium", "High", "High", "Critical"]


def test_risk_band_half_open_edges(spark):
    got = _one(spark, [(0.5,), (0.75,), (0.2499,)], "p double", rules.risk_band("p", closed_upper=False))
    assert got == ["High", "Critical", "Low"]


def test_validation(spark):
    schema = "rain double, d date, district string, soil string, water string"
    rows = [(55.0, dt.date(2026, 8, 1), "Sindh_District", "Moist", "Yes"),
            (None, dt.date(2026, 8, 1), "Sindh_District", "Moist", "Yes"),
            (900.0, dt.date(2026, 8, 1), "Sindh_District", "Moist", "Yes"),
            (55.0, dt.date(2026, 8, 1), "Atlantis", "Moist", "Yes"),
            (55.0, dt.date(2026, 8, 1), "Sindh_District", "Muddy", "Yes"),
            (float("nan"), dt.date(2026, 8, 1), "Sindh_District", "Moist", "Yes")]
    df = spark.createDataFrame(rows, schema).withColumn("rain", rules.to_number("rain"))
    df = df.withColumn("known", F.col("district").isin("Sindh_District", "KP_District"))
    ok = df.select(rules.report_is_valid("rain", "d", "district", "soil", "water", "known").alias("ok"))
    flags = [r.ok for r in ok.collect()]
    assert flags == [True, False, False, False, False, False]
    msg = ok.select(rules.validation_message("ok")).collect()
    assert "Insufficient data" in msg[1][0] and msg[0][0] == ""


def test_guardrail(spark):
    schema = "level string, rain double, soil string, water string"
    rows = [("Medium", 480.0, "Saturated", "Yes"), ("Low", 460.0, "Saturated", "No"),
            ("Critical", 100.0, "Dry", "No"), ("Low", 310.0, "Moist", "Yes"), ("High", 460.0, "Saturated", "No")]
    got = _one(spark, rows, schema, rules.guardrail("level", "rain", "soil", "water"))
    assert got == ["Critical", "High", "Critical", "High", "High"]


def _people(spark, district, population, level, conf):
    regions, divisors, profiles = lookups.reference_exposure_tables(spark)
    pops = spark.createDataFrame(population, "region string, affected_population long")
    df = spark.createDataFrame([(district, level, conf)], "district string, level string, conf double")
    df = lookups.with_exposure(df, regions, divisors, profiles, pops)
    return df.select(rules.people_at_risk("level", "conf", "regional_population", "divisor", "exposure_factor",
                                          "max_exposed_share")).first()[0]


def test_population_goldens(spark):
    ndma = [("Sindh", 14_563_770), ("Balochistan", 9_182_616)]
    assert _people(spark, "Sindh_District", ndma, "Critical", 90.0) == 178_300
    sindh = _people(spark, "Sindh_District", ndma, "Critical", 85.0)
    bal = _people(spark, "Balochistan_District", ndma, "Critical", 85.0)
    assert bal == 142_400 and bal < sindh < 1_000_000
    assert _people(spark, "Atlantis", ndma, "High", 80.0) == 0


def test_text_helpers(spark):
    rows = [("  high ",), ("HIGH",), ("Critical",), ("unknown",), ("",), (None,)]
    got = _one(spark, rows, "v string", rules.normalize_risk("v"))
    assert got == ["High", "High", "Critical", None, None, None]
    trimmed = _one(spark, [("   Issue warning.\t ",), (None,)], "v string", rules.unicode_trim("v"))
    assert trimmed == ["Issue warning.", ""]
    assert _one(spark, [(" KP_District ",)], "v string", rules.display_name("v")) == ["KP District"]


def test_fixed_tables_are_complete():
    assert set(fixed.RISK_ACTIONS) == set(fixed.RISK_LEVELS) == set(fixed.RISK_COLORS) == set(fixed.RISK_LABELS_UR)
    assert sum(fixed.CHOICE_WEIGHTS.values()) == 1.2


def test_unicode_trim_is_the_white_space_pattern(spark):
    """Trimmed by a set of characters: the ends only are looked at, no pattern runs over the whole text."""
    ends = [chr(c) for c in [*range(1, 0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]]
    texts = [None, "", " ", "　 \n", "a", "آب \r\n"] + [f"{e}a {e} ضلعی{e}" for e in ends] + [f"a\n{e}" for e in ends]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select(rules.unicode_trim("t").alias("a"), F.regexp_replace(F.coalesce("t", F.lit("")), r"(?U)^\s+|\s+$", "").alias("b"))
    assert all(r.a == r.b for r in out.collect())
    assert "regexp_replace" not in df.select(rules.unicode_trim("t"))._jdf.queryExecution().optimizedPlan().toString()
