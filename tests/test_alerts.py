"""Alert merging (A12 + O3): the reference's six cases, as DataFrames."""

from tidewatch.operators import alerts

SCHEMA = "district string, risk_level_en string, risk_level_ur string, recommended_action_en string, " \
         "recommended_action_ur string"


def _row(name, level="High", ur="زیادہ", en="Issue district warning.", aur="ضلعی وارننگ جاری کریں۔"):
    return (name, level, ur, en, aur)


def _merge(spark, rows):
    return alerts.merge_alerts(spark.createDataFrame(rows, SCHEMA)).orderBy("alert_rank").collect()


def test_empty(spark):
    assert _merge(spark, []) == []


def test_single_row(spark):
    out = _merge(spark, [_row("Sindh_District")])
    assert len(out) == 1 and out[0].districts == ["Sindh_District"]


def test_merges_identical(spark):
    out = _merge(spark, [_row("Sindh_District"), _row("KP_District"), _row("Jacobabad")])
    assert len(out) == 1 and out[0].districts == ["Jacobabad", "KP_District", "Sindh_District"]


def test_splits_different_actions(spark):
    out = _merge(spark, [_row("Sindh_District", "Critical", "انتہائی"),
                         _row("KP_District", "Critical", "انتہائی", "Evacuate now.", "ابھی انخلا کریں۔")])
    assert len(out) == 2


def test_critical_first(spark):
    out = _merge(spark, [_row("Jacobabad"), _row("Sindh_District", "Critical", "انتہائی", "Different.", "مختلف۔")])
    assert [r.risk_level_en for r in out] == ["Critical", "High"]


def test_whitespace_stripped(spark):
    out = _merge(spark, [_row("A"), _row("B", en="  Issue district warning.  ")])
    assert len(out) == 1 and out[0].districts == ["A", "B"]
