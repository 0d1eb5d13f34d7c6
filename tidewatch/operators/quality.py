"""Data-quality operators.

Each operator is DataFrame in, DataFrame out.  Counting is done by flag
columns aggregated once (see ``tidewatch.plans.clean``), never by a
``count()`` after every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed, rules


def coerce_numeric(df: DataFrame, columns: list[str] = fixed.NUMERIC_COLUMNS) -> DataFrame:
    """Every listed column that exists becomes DOUBLE (bad text and NaN -> null)."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: rules.to_number(c) for c in present})


def parse_dates(df: DataFrame, column: str = "date", pattern: str = fixed.DATE_PATTERN) -> DataFrame:
    """P2 (parse part): the date column becomes DATE, unparsable -> null."""
    return df.withColumn(column, rules.parse_date(column, pattern))


def once_per_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns computed once per row, whatever reads them.

    A filter is moved below the projection that makes its columns and brings a copy of
    their expressions for every use; it cannot go below a generator that yields them.
    """
    made = df.select(*[c for c in df.columns if c not in columns], F.explode(F.array(F.struct(*columns))).alias("_made"))
    return made.select(*[F.col(f"_made.{c}") if c in columns else F.col(c) for c in df.columns])


def drop_bad_dates(df: DataFrame, column: str = "date", pattern: str = fixed.DATE_PATTERN) -> DataFrame:
    """Parse and keep only rows whose date parsed."""
    return parse_dates(df, column, pattern).where(F.col(column).isNotNull())


def null_sentinel(df: DataFrame, column: str = "precipitation", sentinel: float = fixed.RAIN_SENTINEL) -> DataFrame:
    """Sentinel -> null."""
    return df.withColumn(column, rules.sentinel_to_null(column, sentinel))


def null_infinite(df: DataFrame, column: str = "water_area_pct_change") -> DataFrame:
    """+-inf -> null."""
    return df.withColumn(column, rules.finite_or_null(column))


def phantom_flag(df: DataFrame, bounds: dict = fixed.OUTLIER_BOUNDS) -> "F.Column":
    """P5 flag: any present value outside its bounds (absent columns ignored)."""
    return rules.out_of_bounds(bounds, df.columns)


def drop_phantoms(df: DataFrame, bounds: dict = fixed.OUTLIER_BOUNDS) -> DataFrame:
    """P5: remove rows with a value outside its closed range; nulls pass."""
    return df.where(~phantom_flag(df, bounds))


def exact_dedup(df: DataFrame) -> DataFrame:
    """Remove exact duplicate rows (null equals null).

    A hash aggregate on all columns: copies collapse in the map-side partial
    aggregate before the shuffle, so many copies of one row cost no skew.
    """
    return df.dropDuplicates()


def feature_target_frame(df: DataFrame, target: str = "flood_event",
                         drop_columns: list[str] = fixed.DROP_COLUMNS,
                         extra_drop: list[str] | None = None,
                         keep: list[str] | None = None) -> DataFrame:
    """P7 + P14: drop forbidden / leakage-prone columns that exist; target as INT.

    The target stays in the frame as ``label`` (no index alignment needed in
    Spark); ``keep`` lists bookkeeping columns to retain (dates, sequence).
    """
    drop = [c for c in list(drop_columns) + list(extra_drop or []) if c in df.columns and c not in (keep or [])]
    label = F.assert_true(F.col(target).isNotNull(), F.lit(f"null target in {target}"))
    return df.withColumn("label", F.when(label.isNull(), F.col(target).cast("int"))).drop(*drop)


def assert_finite(df: DataFrame, columns: list[str]) -> None:
    """Raise when any listed column holds +-inf (nulls allowed).  One aggregate job."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return
    row = df.agg(*[F.max(rules.is_infinite(F.col(c).try_cast("double")).cast("int")).alias(c)
                   for c in present]).first()
    bad = [c for c in present if row[c]]
    if bad:
        raise ValueError(f"Found infinite values in numeric training inputs: {bad}")


def columns_by_type(df: DataFrame, numeric: bool = True) -> list[str]:
    """Column names by type family."""
    numeric_types = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes if (t in numeric_types or t.startswith("decimal")) == numeric]


def columns_matching(df: DataFrame, fragment: str) -> list[str]:
    """Column names containing a fragment."""
    return [c for c in df.columns if fragment in c]
