"""Ordered operators.

Order is always completed with a unique sequence column, so every result is
defined even where the source sort had ties.

Per-key selections (latest / first / top row, last non-null value) are rank
limits: every task keeps its first row per key before the shuffle, so a key that
holds a third of all rows still sends one row per task.  Running sums and lags need the row order: the plain
versions are windows partitioned by the entity key; ``ordered_scan`` computes
both over range partitions, so a hot key is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import rules


def add_calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    """P9 + P10: month, day of year, year and monsoon flag from the parsed date."""
    d = F.col(date_col)
    return df.withColumns({
        "month": F.month(d),
        "day_of_year": F.dayofyear(d),
        "year": F.year(d),
        "is_monsoon": rules.monsoon_flag(d),
    })


def _null_when_key_null(expr: Column, keys: list[str]) -> Column:
    """Group operations skip null keys (T16): rows with a null key get null."""
    cond = None
    for k in keys:
        cond = F.col(k).isNull() if cond is None else (cond | F.col(k).isNull())
    return F.when(cond, F.lit(None)).otherwise(expr) if cond is not None else expr


def running_sum(df: DataFrame, value: str, partition_cols: list[str], order_cols: list[str], out: str) -> DataFrame:
    """Cumulative sum per partition in order (rows frame, current row included)."""
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, _null_when_key_null(F.sum(value).over(w), partition_cols))


def lag_columns(df: DataFrame, columns: list[str], partition_cols: list[str], order_cols: list[str],
                suffix: str = "_lag1") -> DataFrame:
    """Previous row's value per key (previous row, not previous day)."""
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    return df.withColumns({f"{c}{suffix}": _null_when_key_null(F.lag(c, 1).over(w), partition_cols)
                           for c in columns})


def _pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in ``order``: a rank limit, which Spark applies before the exchange as well,
    so a hot key sends one row per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place <= 1").drop("_place")


def latest_row(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """The last row per key in (order_cols) order."""
    return _pick(df, keys, [F.col(c).desc_nulls_last() for c in order_cols])


def first_row(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """The first row per key in (order_cols) order (dedup on a subset)."""
    return _pick(df, keys, [F.col(c).asc_nulls_first() for c in order_cols])


def top_row(df: DataFrame, keys: list[str], measure: str, date_col: str, seq_col: str) -> DataFrame:
    """Row with the largest measure per key (ties: earliest date, then sequence);
    a key with no measure at all gives its latest row."""
    has = F.col(measure).isNotNull()
    day = F.datediff(F.col(date_col), F.lit("1970-01-01").cast("date"))
    seq = F.col(seq_col).cast("long")
    return _pick(df, keys, [F.when(has, 0).otherwise(1), F.when(has, -F.col(measure)).otherwise(F.lit(0.0)),
                            F.when(has, day).otherwise(-day), F.when(has, seq).otherwise(-seq)])


def last_value(df: DataFrame, keys: list[str], value: str, order_cols: list[str], out: str | None = None) -> DataFrame:
    """Last non-null value per key in order."""
    there = df.where(F.col(value).isNotNull()).select(*keys, *[c for c in order_cols if c not in keys], F.col(value).alias("_value"))
    return latest_row(there, keys, order_cols).select(*keys, F.col("_value").alias(out or value))


# --- ordered scan over range partitions (hot keys) ---------------------------------------------

SCAN_ROWS = 2_000_000   # rows a range partition holds about
CARRY_ROWS = 500_000    # carry rows up to which a table without a proven bound is broadcast


def ordered_scan(df: DataFrame, keys: list[str], order_cols: list[str], lag_cols: list[str] = (),
                 sums: list[tuple[str, list[str], str]] = (), suffix: str = "_lag1",
                 partitions: int | None = None, skip_null_keys: bool = True) -> DataFrame:
    """W1 + W2 without a window over a whole key.

    Rows are range-partitioned by (keys, order) -- the sampled bounds split a key
    holding a third of the rows over many partitions -- and tagged with their
    partition id, then written once (``cut_lineage``) so the tags are stable.
    Windows run per (partition, key) slice; each slice's first row takes its
    previous row from the last row of the key in an earlier partition, and
    running sums add the totals of earlier partitions.  Both carries have a row
    only for a key that goes on from an earlier partition: one key per partition
    (sums with extra columns that do not rise with the order may have more).

    ``sums``: (value column, extra partition columns, output column), e.g.
    ("rain", ["year"], "cumulative_rain") for a running sum per (key, year); the
    sum is null until a value has been seen.  ``partitions`` defaults to one per
    ``SCAN_ROWS`` rows and at least the session's shuffle partitions.  Rows with
    a null key get null lags and sums (group operations skip null keys) unless
    ``skip_null_keys`` is off, which makes null a key like others.
    """
    from tidewatch.session import cut_lineage

    spark = df.sparkSession
    n_parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SCAN_ROWS))
    ranged = df.repartitionByRange(n_parts, *keys, *order_cols).withColumn("_pid", F.spark_partition_id())
    ranged = cut_lineage(ranged, "ordered-scan")
    slice_w = Window.partitionBy("_pid", *keys).orderBy(*order_cols)
    out = ranged.withColumn("_rn", F.row_number().over(slice_w)) if lag_cols else ranged
    out = out.withColumns({f"_local_{c}": F.lag(c, 1).over(slice_w) for c in lag_cols})
    for value, extra, name in sums:
        w = Window.partitionBy("_pid", *keys, *extra).orderBy(*order_cols) \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(f"_local_{name}", F.sum(value).over(w))

    def attach(big: DataFrame, small: DataFrame, on: list[str], bounded: bool) -> DataFrame:
        """Left join with a carry table, nulls equal.  Broadcast where it has one key per partition at most, or
        is found to have few rows."""
        if not bounded:
            small = cut_lineage(small, "carry")
            bounded = small.count() <= CARRY_ROWS
        named = small.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in small.columns if c not in on])
        same = None
        for c in on:
            term = F.col(c).eqNullSafe(F.col(f"_on_{c}"))
            same = term if same is None else same & term
        return big.join(F.broadcast(named) if bounded else named, same, "left").drop(*[f"_on_{c}" for c in on])

    if lag_cols:
        last = ranged.groupBy("_pid", *keys).agg(
            F.max_by(F.struct(*[F.col(c) for c in lag_cols]), F.struct(*[F.col(c) for c in order_cols]))
            .alias("_last"))
        carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_pid"))) \
            .drop("_last").where(F.col("_carry").isNotNull())
        out = attach(out, carry, ["_pid", *keys], True)
        out = out.withColumns({f"{c}{suffix}": F.when(F.col("_rn") == 1, F.col("_carry")[c])
                               .otherwise(F.col(f"_local_{c}")) for c in lag_cols}).drop("_carry")
    for value, extra, name in sums:
        tot = ranged.groupBy("_pid", *keys, *extra).agg(F.sum(value).alias("_part"))
        earlier = Window.partitionBy(*keys, *extra).orderBy("_pid") \
            .rowsBetween(Window.unboundedPreceding, -1)
        tot = tot.withColumn(f"_off_{name}", F.sum("_part").over(earlier)).drop("_part").where(F.col(f"_off_{name}").isNotNull())
        out = attach(out, tot, ["_pid", *keys, *extra], not extra)
        local, off = F.col(f"_local_{name}"), F.col(f"_off_{name}")
        out = out.withColumn(name, F.when(local.isNotNull() | off.isNotNull(),
                                          F.coalesce(local, F.lit(0)) + F.coalesce(off, F.lit(0)))).drop(f"_off_{name}")
    if skip_null_keys:
        nulls = {f"{c}{suffix}": _null_when_key_null(F.col(f"{c}{suffix}"), keys) for c in lag_cols}
        nulls.update({name: _null_when_key_null(F.col(name), keys + list(extra)) for _, extra, name in sums})
        out = out.withColumns(nulls)
    drop = ["_pid", "_rn"] + [f"_local_{c}" for c in lag_cols] + [f"_local_{n}" for _, _, n in sums]
    return out.drop(*drop)
