"""Joins against dimension tables.

A many-to-one join needs unique dimension keys.  The check is part of the plan:
the dimension is grouped by its keys and a key with several rows raises when
the join runs, so it always sees the rows that are joined, and no job runs
before the action.  Broadcasting is left to the planner, which goes by the
dimension's size in bytes (at planning and, with AQE, at run time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked_dimension(dim: DataFrame, keys: list[str], unique: bool = True) -> DataFrame:
    """The dimension without rows of null keys (they match nothing); a repeated key raises at run time."""
    known = dim.dropna(subset=list(keys))
    if not unique:
        return known
    rest = [c for c in dim.columns if c not in keys]
    one = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in rest])
    said = F.concat(F.lit(f"dimension keys {list(keys)} are not unique: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    checked = {k: F.when(F.col("_rows") > 1, F.raise_error(said)).otherwise(F.col(k)) for k in keys}
    return one.select(*[checked[c].alias(c) if c in checked else F.col(c) for c in dim.columns])


def join_dimension(fact: DataFrame, dim: DataFrame, keys: list[str], how: str = "left",
                   unique: bool = True) -> DataFrame:
    """Equi-join of a fact table with a dimension of unique keys."""
    return fact.join(checked_dimension(dim, keys, unique), on=keys, how=how)
