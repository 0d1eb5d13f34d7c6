"""Exact ranks and order statistics (used by W7-W10, quantiles and the ROC AUC).

Equal rows are counted first (a map-side combined aggregate, so ties and hot
values collapse); the distinct rows are then numbered by an ordered scan over
range partitions, which spreads any group over many tasks.  Values keep their
types: 64-bit ids, dates and infinities sort as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import timeseries
from tidewatch.session import cut_lineage


def value_ranks(df: DataFrame, groups: list[str], order_cols: list[str]) -> DataFrame:
    """One row per distinct (groups, order_cols): ``n`` equal rows, the last of which has rank ``upto`` (from 1)
    in the group's ascending order.  A null group is a group; null order values come first."""
    # written before the scan, whose sizes and bounds then come from this small table
    counts = cut_lineage(df.groupBy(*groups, *order_cols).agg(F.count(F.lit(1)).alias("n")), "value-counts")
    return timeseries.ordered_scan(counts, list(groups), list(order_cols), sums=[("n", [], "upto")], skip_null_keys=False)


def holds_rank(k: Column | int) -> Column:
    """The 0-based rank ``k`` falls on this row of ``value_ranks``."""
    return (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k)


def _any_of(terms: list[Column]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | t
    return out


def kth_rows(df: DataFrame, order_cols: list[str], ks: list[int]) -> list[tuple]:
    """Values of ``order_cols`` at the given 0-based ranks (rows with a null in them do not count).

    Hierarchical: rows are counted per value of the first column, the running
    counts name the values that the ranks fall on, and only the rows of those
    values are ranked by the other columns.
    """
    src = df.select(*order_cols).dropna()
    first, rest = order_cols[0], list(order_cols[1:])
    found = value_ranks(src, [], [first]).where(_any_of([holds_rank(F.lit(k)) for k in ks])).collect()  # a row per rank at most
    edges = []
    for k in ks:
        row = next((r for r in found if r["upto"] - r["n"] <= k < r["upto"]), None)
        if row is None:
            raise IndexError(f"rank {k} outside the rows")
        edges.append((row[first], k - (row["upto"] - row["n"])))
    if not rest:
        return [(v,) for v, _ in edges]
    inner = value_ranks(src.where(_any_of([F.col(first) == F.lit(v) for v in {v for v, _ in edges}])), [first], rest)
    at = inner.where(_any_of([(F.col(first) == F.lit(v)) & holds_rank(F.lit(k)) for v, k in edges])).collect()
    return [next(tuple(r[c] for c in order_cols) for r in at if r[first] == v and r["upto"] - r["n"] <= k < r["upto"]) for v, k in edges]


def kth_row(df: DataFrame, order_cols: list[str], k: int) -> tuple:
    """Values of ``order_cols`` at the k-th row (0-based) of the lexicographic order."""
    return kth_rows(df, order_cols, [k])[0]


def before(order_cols: list[str], cut: tuple) -> Column:
    """Row precedes the cut row (strictly) in lexicographic order."""
    expr = None
    for i in reversed(range(len(order_cols))):
        c, v = F.col(order_cols[i]), F.lit(cut[i])
        term = c < v if expr is None else (c < v) | ((c == v) & expr)
        expr = term
    return expr
