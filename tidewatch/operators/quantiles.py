"""Quantiles and medians.

``method="exact"`` is linear interpolation between the two order statistics
around ``p * (n - 1)``, whatever the size of the table or of a group.  A mergeable
sketch per group and column gives values that enclose the quantile by its proven
rank error; one pass counts what lies below, and of the rest only the values inside (all of a
group of at most ``BRACKET`` values) are counted and ranked over range partitions
(``selection.value_ranks``), so no group meets in one task.  Null and NaN are missing values and skipped;
infinities are values, and between a finite value and an
infinity lies the infinity.  A group without values gives null.  ``method="approx"``
is Spark's streaming sketch with a bounded relative rank error (``accuracy``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import selection
from tidewatch.session import cut_lineage

BRACKET = 500   # accuracy of the sketch: a rank is off by a 500th of the group at most


def present(c: str) -> Column:
    """The column as a double, null where it is missing (null or NaN)."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def quantile_table(df: DataFrame, specs: dict[str, tuple[str, float]], group_cols: list[str] = (),
                   method: str = "exact", drop_null_keys: bool = True, accuracy: int = 10000) -> DataFrame:
    """One row per group: ``{out_name: quantile(col, p)}`` for every spec.

    Null group keys are dropped (group-by in the source skips them) unless
    ``drop_null_keys`` is off.
    """
    g = list(group_cols)
    src = df.dropna(subset=g) if g and drop_null_keys else df
    if method == "approx":
        return (src.groupBy(*g) if g else src).agg(
            *[F.percentile_approx(present(c), F.lit(p), F.lit(accuracy)).alias(name) for name, (c, p) in specs.items()])
    # 1. a sketch per group and column: values that enclose every quantile, by its proven rank error
    cols = sorted({c for c, _ in specs.values()})
    src = src.select(*g, *[present(c).alias(f"_x_{c}") for c in cols])
    margin, ends = 4 / BRACKET, {c: sorted({p for d, p in specs.values() if d == c}) for c in cols}
    sketch = {c: F.percentile_approx(f"_x_{c}", [min(max(p + s * margin, 0.0), 1.0) for p in ends[c] for s in (-1, 1)], BRACKET) for c in cols}
    aggregates = [x for c in cols for x in (F.count(f"_x_{c}").alias(f"_n_{c}"), sketch[c].alias(f"_b_{c}"))]
    number = F.monotonically_increasing_id() if g else F.lit(0).cast("long")
    around = cut_lineage((src.groupBy(*g) if g else src).agg(*aggregates).withColumn("_id", number), "brackets")

    def fence(c: str, p: float, side: int) -> Column:
        """A bound below (0) or above (1) the quantile; none for a group of few values or beyond the range."""
        open_end = F.lit(float("inf") if side else float("-inf"))
        outside = (F.col(f"_n_{c}") <= BRACKET) | F.lit(p + margin >= 1.0 if side else p - margin <= 0.0)
        return F.when(outside, open_end).otherwise(F.col(f"_b_{c}")[2 * ends[c].index(p) + side])

    # 2. one pass: values below a bracket count as null, which ranks first; the few inside are ranked
    # a value and its column per row (all columns' conditions side by side make a method too long to compile); rows
    # carry their group's number, and number and column make one long key, the cheapest to look up
    rows = src
    if g:
        same = F.lit(True)
        for c in g:
            same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        rows = src.join(around.select("_id", *[F.col(c).alias(f"_g_{c}") for c in g]), same)
    rows = rows.select(F.col("_id") if g else F.lit(0).cast("long").alias("_id"), *[F.col(f"_x_{c}").alias(str(i)) for i, c in enumerate(cols)])
    key = lambda i: F.col("_id") * len(cols) + i
    names = list(specs)
    fences = F.array(*[F.struct(F.lit(j).alias("_s"), key(F.lit(cols.index(c))).alias("_of"), fence(c, p, 0).alias("_low"), fence(c, p, 1).alias("_high"))
                       for j, (c, p) in enumerate(specs.values())])
    fences = around.select(F.explode(fences).alias("_f")).select("_f.*")
    long = rows.unpivot(["_id"], [str(i) for i in range(len(cols))], "_c", "_x").where(F.col("_x").isNotNull())
    upto = long.join(fences if g else F.broadcast(fences), key(F.col("_c").cast("int")) == F.col("_of")).where(F.col("_x") <= F.col("_high")) \
        .select("_id", "_s", F.when(F.col("_x") >= F.col("_low"), F.col("_x")).alias("_x"))
    ranks = selection.value_ranks(upto, ["_id", "_s"], ["_x"]).withColumnRenamed("_id", "_of")
    wide = around.select("_id", *[F.col(c).alias(f"_g_{c}") for c in g], *[f"_n_{c}" for c in cols])
    joined = wide.join(ranks, F.col("_id") == F.col("_of"), "left")  # without groups: one row with the few ranked values
    picks = []
    for name, (c, p) in specs.items():
        pos = F.lit(p) * (F.col(f"_n_{c}") - 1)
        mine = (F.col("_s") == names.index(name)) & (F.col(f"_n_{c}") > 0)
        low, high = (selection.holds_rank(f(pos)) for f in (F.floor, F.ceil))
        picks += [F.max(F.when(mine & low, F.col("_x"))).alias(f"_lo_{name}"), F.max(F.when(mine & high, F.col("_x"))).alias(f"_hi_{name}"),
                  F.max(F.when(F.col(f"_n_{c}") > 0, pos - F.floor(pos))).alias(f"_t_{name}")]
    keys = [f"_g_{c}" for c in g]
    found = (joined.groupBy(*keys) if g else joined).agg(*picks).withColumnsRenamed({f"_g_{c}": c for c in g})

    def between(name: str) -> Column:
        lo, hi, t = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_t_{name}")
        lost = t.isNotNull() & (lo.isNull() | hi.isNull())
        lo = F.when(lost, F.raise_error(F.lit(f"{name}: a rank lies outside its bracket")).cast("double")).otherwise(lo)
        step = hi - lo  # the convention of the common array libraries: from the nearer end
        return F.when((lo == hi) | (t == 0) | (lo == float("-inf")), lo).when(hi == float("inf"), hi).when(t >= 0.5, hi - step * (F.lit(1.0) - t)).otherwise(lo + step * t)

    return found.select(*g, *[between(name).alias(name) for name in specs])


def medians(df: DataFrame, value_cols: list[str], group_cols: list[str] = (), method: str = "exact") -> DataFrame:
    """A1 / A2: median of every value column, per group or over the whole table."""
    return quantile_table(df, {c: (c, 0.5) for c in value_cols}, group_cols, method)


def winsor_bounds(df: DataFrame, column: str, low: float, high: float, method: str = "exact") -> DataFrame:
    """A3: the one-row table (lo, hi) of the column's ``low`` / ``high`` quantiles."""
    return quantile_table(df, {"_lo": (column, low), "_hi": (column, high)}, (), method)


def winsorize(df: DataFrame, column: str, low: float, high: float, method: str = "exact") -> DataFrame:
    """Clip the column to its quantiles; nulls stay null.

    The bounds are one row: the cross join is a broadcast of a single row.
    """
    bounds = winsor_bounds(df, column, low, high, method)
    x = F.col(column)
    clipped = F.when(x.isNotNull(), F.least(F.greatest(x, F.col("_lo")), F.col("_hi")))
    return df.crossJoin(F.broadcast(bounds)).withColumn(column, clipped).drop("_lo", "_hi")


def fill_with_medians(df: DataFrame, columns: list[str], method: str = "exact", found: DataFrame | None = None) -> DataFrame:
    """A4: fill nulls of each column with that column's global median (one broadcast row; ``found`` if it is already there)."""
    med = (medians(df, columns, (), method) if found is None else found).select(*[F.col(c).alias(f"_med_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(med))
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_med_{c}")) for c in columns})
    return out.drop(*[f"_med_{c}" for c in columns])
