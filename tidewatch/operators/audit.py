"""Audit tables (A7-A10, A17, C9 data-quality block, C11).

All are aggregates; results are small by construction (one row, one row per
column, one row per crosstab cell, five samples per column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import quality
from tidewatch.session import cut_lineage


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows repeating an earlier key (count - distinct keys; null equals null)."""
    return df.agg((F.count(F.lit(1)) - F.count_distinct(F.struct(*[F.col(k) for k in keys])))
                  .cast("long").alias("duplicate_keys"))


def label_rate(df: DataFrame, label: str = "flood_event") -> DataFrame:
    """Share of positive labels."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("label_rate"))


def target_correlations(df: DataFrame, target: str, exclude: list[str] = (), top: int = 12) -> DataFrame:
    """|Pearson r| of every numeric column with the target, largest first, top ``top``.

    Pairs with a null on either side are skipped.  A column that is constant over
    those pairs has no correlation (null, sorted last); it is detected in a first
    aggregate so the correlation itself never divides by zero.
    """
    cols = [c for c in quality.columns_by_type(df, numeric=True) if c != target and c not in exclude]
    t = F.col(target).cast("double")

    def pairs(cols: list[str]) -> DataFrame:
        """A column's value and the target's per row: all columns' sums side by side make a method too long to compile."""
        return df.select(t.alias("_t"), *[F.col(c).cast("double").alias(c) for c in cols]).where(F.col("_t").isNotNull()) \
            .unpivot(["_t"], cols, "feature", "_x").where(F.col("_x").isNotNull())

    spread = pairs(cols).groupBy("feature").agg(
        (F.min("_x") < F.max("_x")).alias("varies"), (F.min("_t") < F.max("_t")).alias("target_varies")).collect()  # a row per column
    live = sorted(r["feature"] for r in spread if r["varies"] and r["target_varies"])
    long = df.sparkSession.createDataFrame([(c, None) for c in cols if c not in live], "feature string, abs_corr double")
    if live:
        long = long.unionByName(pairs(live).groupBy("feature").agg(F.abs(F.corr("_x", "_t")).alias("abs_corr")))
    return long.orderBy(F.col("abs_corr").isNull(), F.col("abs_corr").desc(), F.col("feature")).limit(top)


def crosstab(df: DataFrame, row: str, col: str, prefix: str | None = None) -> DataFrame:
    """A10: counts of ``row`` x ``col`` values (rows with a null in either dropped), zeros filled."""
    src = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    values = sorted(r[0] for r in src.select(col).distinct().collect())  # distinct labels: bounded
    wide = src.groupBy(row).pivot(col, values).count().na.fill(0)
    prefix = prefix if prefix is not None else f"{col}_"
    return wide.select(row, *[F.col(f"`{v}`").cast("long").alias(f"{prefix}{v}") for v in values])


def crosstab_long(df: DataFrame, row: str, col: str, out: str = "n") -> DataFrame:
    """A10 in long form: one cell per pair of occurring values, zeros included; no value comes to the driver.

    The grid of all pairs of values is the result's own size.
    """
    src = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    cells = cut_lineage(src.groupBy(row, col).agg(F.count(F.lit(1)).cast("long").alias(out)), "cells")
    grid = cells.select(row).distinct().crossJoin(cells.select(col).distinct())
    return grid.join(cells, [row, col], "left").select(row, col, F.coalesce(out, F.lit(0).cast("long")).alias(out))


def first_distinct(df: DataFrame, column: str, seq_col: str, n: int = 5) -> DataFrame:
    """The first ``n`` distinct non-null values in row order (a top-n report)."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(seq_col).alias("_first"))
    return firsts.orderBy("_first", column).limit(n).select(
        F.lit(column).alias("column"), F.col(column).cast("double").alias("value"), F.col("_first").alias("first_seen"))
