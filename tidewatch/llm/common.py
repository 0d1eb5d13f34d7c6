"""Pieces shared by the operators: ordered neighbours and connected components."""

from __future__ import annotations

import sys
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.session import cut_lineage

LOWEST = -(2 ** 63)


def ship(module_name: str) -> None:
    """Send a module's Python functions along with the tasks that use them, so workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Rows per Arrow batch of the Python stages that run inside, so that batches of long texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def id_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids: null)."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def with_next(df: DataFrame, order_col: str, tie_col: str, carry: dict[str, str],
              derive: dict[str, Column] | None = None, buckets: int | None = None) -> DataFrame:
    """Add the ``carry`` columns (existing or derived -> new name) of the next row in ascending order.

    ``derive`` columns are computed once per row, before rows are dealt out.
    After the last row comes the first.  Null order values come first; rows with
    equal order values are ordered by ``tie_col``.  Rows are dealt into ranges of
    the order column (bounds from one approximate-percentile aggregate, as many
    as ``buckets``), so every window sorts one range; each range also receives a
    marker copy of the following range's first rows, which supplies the
    neighbour of its last row.  What comes to the driver is one bound and one
    smallest value per range.
    """
    spark = df.sparkSession
    n = buckets or 4 * shuffle_partitions(spark)
    keyed = df.withColumn("_ord", F.coalesce(F.col(order_col).cast("long"), F.lit(LOWEST)))
    slim = df.select(F.coalesce(F.col(order_col).cast("long"), F.lit(LOWEST)).alias("_ord"))
    bounds = []
    if n > 1:
        found = slim.agg(F.percentile_approx("_ord", [i / n for i in range(1, n)], 10000)).first()[0]
        bounds = sorted(set(found or []))

    def ranged(d: DataFrame) -> DataFrame:
        if not bounds:
            return d.withColumn("_bucket", F.lit(0))
        return d.withColumn("_bucket", F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("_ord"))))

    firsts = sorted((r[0], r[1]) for r in ranged(slim).groupBy("_bucket").agg(F.min("_ord")).collect())
    target = [(least, firsts[i - 1][0]) for i, (_, least) in enumerate(firsts)]  # the first goes behind the last
    marks = F.broadcast(spark.createDataFrame(target, "_ord long, _bucket int"))
    body = ranged(keyed).withColumn("_mark", F.lit(0))
    marked = keyed.join(marks, "_ord").withColumn("_mark", F.lit(1))
    w = Window.partitionBy("_bucket").orderBy("_mark", "_ord", tie_col)
    both = body.unionByName(marked).withColumns(derive or {})
    out = both.withColumn("_next", F.lead(F.struct(*carry)).over(w)).where("_mark = 0")
    return out.select(*df.columns, *(derive or {}), *[F.col("_next")[a].alias(b) for a, b in carry.items()])


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of an undirected edge list: (id, component = smallest id).

    Contraction rounds: every node moves to the neighbour (or itself) of most
    neighbours, ties by a random rank of the round, and on to where that one moves;
    edges are relabelled and those inside one node go.  A node that stays has at
    least as many neighbours as any of them, so at least half of the nodes with
    edges disappear per round, and a star is one node after the first.  Only
    groupings with map-side minima and equi-joins; each round is written to the
    checkpoint folder.  Null ends and self loops are ignored; nodes without an edge
    have no row.
    """
    e = edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")) \
        .where("u is not null and v is not null and u < v").distinct()
    e = cut_lineage(e, "edges")
    labels = None
    turn = 0
    while not e.isEmpty():
        turn += 1
        rank = lambda n, c: F.struct((-F.col(n)).alias("n"), F.xxhash64(F.col(c), F.lit(turn)).alias("r"), F.col(c).alias("id"))
        both = e.union(e.select("v", "u"))
        degree = both.groupBy(F.col("u").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        step = both.join(degree, "v").groupBy("u").agg(F.count(F.lit(1)).alias("own"), F.min(rank("n", "v")).alias("best")) \
            .select(F.col("u").alias("node"), F.least(F.col("best"), rank("own", "u"))["id"].alias("to"))
        step = cut_lineage(step, "steps")
        on = step.where("node <> to").select(F.col("node").alias("to"), F.col("to").alias("on"))
        step = cut_lineage(step.join(on, "to", "left").select("node", F.coalesce("on", "to").alias("to")), "steps")
        a = step.select(F.col("node").alias("u"), F.col("to").alias("u2"))
        b = step.select(F.col("node").alias("v"), F.col("to").alias("v2"))
        moved = e.join(a, "u").join(b, "v").select(F.col("u2").alias("u"), F.col("v2").alias("v"))  # every end has a step
        if labels is None:
            labels = step.select(F.col("node").alias("id"), F.col("to").alias("label"))
        else:
            labels = cut_lineage(labels.join(step, labels.label == step.node, "left")
                                 .select("id", F.coalesce("to", "label").alias("label")), "labels")
        e = cut_lineage(moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                        .distinct(), "edges")
    if labels is None:  # no edge at all
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(least, "label").select("id", "component")


def joined_components(classes: DataFrame, edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``components`` of a graph whose ``classes`` (id, component) are known, with further ``edges`` added.

    The edges are lifted to the classes, and only those between unlike ones are contracted.
    """
    ends = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    a = classes.select(F.col("id").alias("u"), F.col("component").alias("u2"))
    b = classes.select(F.col("id").alias("v"), F.col("component").alias("v2"))
    ends = cut_lineage(ends.join(a, "u", "left").join(b, "v", "left").select("u", "v", F.coalesce("u2", "u").alias("cu"),
                                                                            F.coalesce("v2", "v").alias("cv")), "lifted")
    if ends.isEmpty():
        return classes
    known = classes.union(ends.select("u", "cu").union(ends.select("v", "cv"))).distinct()
    over = components(ends.select("cu", "cv"), "cu", "cv").toDF("component", "wide")
    return known.join(over, "component", "left").select("id", F.coalesce("wide", "component").alias("component"))
