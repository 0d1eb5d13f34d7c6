"""Registered queries: one Spark plan per operator, with its DuckDB twin.

Every query reads the driver's tables at ``sf_dir`` (through the fixture
source) and runs over whole tables.  Derived doubles are rounded to six places
on both sides before comparison; counts are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            from tidewatch.plans.oracle import spark_rounding
            ORACLE[name] = spark_rounding(sql)
        return fn
    return deco


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every DOUBLE column (the comparison rule for derived values)."""
    return df.select(*[F.round(F.col(c), places).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


QUERY_MODULES = ["q_clean", "q_lookups", "q_scoring", "q_scenarios", "q_windows", "q_splits", "q_metrics",
                 "q_audit", "q_learn", "q_exact"]


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib
    import os

    here = os.path.dirname(__file__)
    for m in QUERY_MODULES:
        if os.path.exists(os.path.join(here, f"{m}.py")):
            importlib.import_module(f"tidewatch.plans.{m}")
