"""Mixing sources to target weights by Poisson replication.

A document of source s has the mean repetition rate
``target_rows * weight(s) / rows(s)``.  A uniform number drawn from the
document's id inverts the Poisson distribution with that mean; the document is
repeated that often, and copies are dealt out in the order of a seeded digest.

Defined cases: a null source is a source of its own; null ids share the draw of
the empty id; repeated rows draw alike; an empty table gives an empty result;
further columns pass through, and those named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADDED = ["copy", "shuffle_key"]
BROADCAST_BYTES = 8_000_000   # largest table of sources that is broadcast


def uniform(text: F.Column) -> F.Column:
    """52 bits of the md5 of ``text`` as a double in (0, 1)."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2 ** 52))


def source_rates(df: DataFrame, source_col: str, weights: dict | None = None, alpha: float = 0.5,
                 target_rows: int | None = None) -> DataFrame:
    """(source, rows, rate): one row per source from one map-side combined count.

    ``weights`` gives relative target weights (sources without one: 0); without
    it a source's weight is its row count to the power ``alpha``.
    """
    counts = df.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        w = F.pow(F.col("rows").cast("double"), F.lit(float(alpha)))
    else:
        w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source")).cast("double"),
                       F.lit(0.0))
    counts = counts.withColumn("w", w)
    n, sum_w = counts.agg(F.sum("rows"), F.sum("w")).first()  # two numbers
    if not sum_w:
        return counts.select("source", "rows", F.lit(0.0).alias("rate"))
    return counts.select("source", "rows", (F.lit(float(target_rows or n)) * F.col("w") / F.lit(float(sum_w))
                                            / F.col("rows")).alias("rate"))


def poisson_inverse(u: F.Column, rate: F.Column) -> F.Column:
    """Smallest k with P(X <= k) >= u for X ~ Poisson(rate).

    The cumulative terms are summed in log space up to rate + 12 sqrt(rate) + 24,
    beyond which the remaining mass is below the draw's resolution.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    walk = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.lit(0).alias("k"), (-rate).alias("log_p"), F.exp(-rate).alias("cdf")),
        lambda s, i: F.when(s["cdf"] >= u, s).otherwise(F.struct(
            i.alias("k"), (s["log_p"] + F.log(rate) - F.log(i.cast("double"))).alias("log_p"),
            (s["cdf"] + F.exp(s["log_p"] + F.log(rate) - F.log(i.cast("double")))).alias("cdf"))),
        lambda s: s["k"])
    return F.when(rate > 0, walk).otherwise(F.lit(0))


def replicate(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None,
              alpha: float = 0.5, target_rows: int | None = None, seed: int = 17) -> DataFrame:
    """Repeat every row by its Poisson count and shuffle all copies.

    Adds ``copy`` (from 0) and ``shuffle_key`` (digest of seed, id and copy): copies
    are dealt to partitions and sorted within them by it, so one source or one
    document's copies spread over all partitions.  The rate of a row's source
    comes by an equi-join with the one-row-per-source table, which is broadcast
    if its measured size is small and joined by shuffle otherwise.
    """
    df = df.select(*[c for c in df.columns if c not in ADDED])
    rates = source_rates(df, source_col, weights, alpha, target_rows) \
        .select(F.col("source").alias("_src"), F.col("rate").alias("_rate"))
    chars, sources = rates.agg(F.sum(F.coalesce(F.octet_length(F.col("_src").cast("string")), F.lit(0))), F.count(F.lit(1))).first()
    if (chars or 0) + 16 * sources <= BROADCAST_BYTES:
        rates = F.broadcast(rates)
    rated = df.join(rates, df[source_col].eqNullSafe(F.col("_src")), "left")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    u = uniform(F.concat(F.lit(f"{seed}:"), key))
    times = rated.withColumn("_times", poisson_inverse(u, F.coalesce(F.col("_rate"), F.lit(0.0)))).where("_times > 0")
    copies = times.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times").cast("long") - 1)))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}/"), key, F.lit("/"), F.col("copy").cast("string"))
                                                    .cast("binary")))
    return copies.drop("_src", "_rate", "_times") \
        .repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
