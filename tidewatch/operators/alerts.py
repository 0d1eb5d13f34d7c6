"""A12 + O3: merge alerts that carry the same advisory, ordered by severity.

Grouping keys are the level as given plus the trimmed Urdu label and actions;
districts of a group are collected and sorted (duplicates kept).  The list is
bounded by the district dimension because alerts arrive one row per district
per condition set (see ``plans.scoring.alert_fanout``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import fixed, rules
from tidewatch.operators import timeseries
from tidewatch.session import cut_lineage

ADVISORY_KEYS = ["risk_level_en", "risk_level_ur", "recommended_action_en", "recommended_action_ur"]


def severity(level) -> "F.Column":
    """O3: Critical 0, High 1, Medium 2, Low 3, anything else 99."""
    return F.coalesce(rules.literal_map(fixed.ALERT_SEVERITY)[rules.col(level)],
                      F.lit(fixed.UNKNOWN_ALERT_SEVERITY))


def merge_alerts(rows: DataFrame, group_cols: list[str] = ()) -> DataFrame:
    """A12 + O3: one row per (group, identical advisory) with the sorted district list
    and ``alert_rank`` (1 = first shown) inside each group."""
    keyed = rows.select(*group_cols, "district", "risk_level_en",
                        rules.unicode_trim("risk_level_ur").alias("risk_level_ur"),
                        rules.unicode_trim("recommended_action_en").alias("recommended_action_en"),
                        rules.unicode_trim("recommended_action_ur").alias("recommended_action_ur"))
    merged = keyed.groupBy(*group_cols, *ADVISORY_KEYS).agg(
        F.array_sort(F.collect_list("district")).alias("districts"))
    first = F.lower(F.element_at("districts", 1))
    w = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))
    w = w.orderBy(severity("risk_level_en"), first, *ADVISORY_KEYS)
    return merged.withColumn("alert_rank", F.row_number().over(w)) \
        .select(*group_cols, "alert_rank", "districts", *ADVISORY_KEYS)


def merge_all_alerts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A12 + O3 over the whole table: (alerts, members), linked by ``alert_rank``.

    alerts: one row per identical advisory with its rank (1 = first shown) and the
    number of rows merged; members: (alert_rank, district, times).  No list is
    built and nothing is ranked in one task: the advisories are numbered by an
    ordered scan over ranges, and districts are counted before they move.
    """
    keyed = rows.select("district", F.col("risk_level_en"), *[rules.unicode_trim(c).alias(c) for c in ADVISORY_KEYS[1:]])
    counted = cut_lineage(keyed.groupBy(*ADVISORY_KEYS, "district").agg(F.count(F.lit(1)).alias("times")), "alert-members")
    merged = counted.groupBy(*ADVISORY_KEYS).agg(F.lower(F.min("district")).alias("_first"), F.sum("times").cast("long").alias("merged"))
    merged = cut_lineage(merged.withColumns({"_severity": severity("risk_level_en"), "_one": F.lit(1)}), "alerts")
    ranked = timeseries.ordered_scan(merged, [], ["_severity", "_first", *ADVISORY_KEYS], sums=[("_one", [], "alert_rank")], skip_null_keys=False)
    ranked = cut_lineage(ranked.withColumn("alert_rank", F.col("alert_rank").cast("long")), "ranked-alerts")
    same = F.lit(True)
    for c in ADVISORY_KEYS:
        same = same & F.col(f"_c_{c}").eqNullSafe(F.col(c))
    members = counted.withColumnsRenamed({c: f"_c_{c}" for c in ADVISORY_KEYS}).join(ranked, same).select("alert_rank", "district", "times")
    return ranked.select("alert_rank", *ADVISORY_KEYS, "merged"), members


def banner_text(merged: DataFrame) -> DataFrame:
    """display names of a merged alert joined with commas."""
    return merged.withColumn("district_names",
                             F.array_join(F.transform("districts", lambda d: rules.display_name(d)), ", "))
