"""URL rules by a sort-merge range join.

A rule (host, path) covers the host and its subdomains where the url's path
starts with the rule's.  The canonical key of a host and path is the reversed
host labels, a separator, and the path; a rule is then the interval of keys
that start with its key, and intervals nest or are disjoint.  A url is probed
with one key per domain suffix of its host (no deeper than the deepest rule).
Probes and rules are sorted together by key; at a probe, the last rule before
it carries the stack of the rules nested around it, and those of the stack that
still contain the probe are active.

Only DataFrame functions.  Defined cases: null urls and urls without ``://``
have empty host and path and no rule; repeated urls are probed once; rules with
null parts are ignored; of rules with one key the last action in text order
holds; with no rules every url has the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.session import cut_lineage

from .common import shuffle_partitions

SEP = "\u0001"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.when(url.contains("://"), F.substring_index(F.substring(url, F.locate("://", url) + 3, F.length(url)), "/", 1)) \
        .otherwise(F.lit(""))
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    cut = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    at = F.locate("/", cut)
    return F.coalesce(F.when(at > 0, F.substring(cut, at, F.length(cut))).otherwise(F.lit("")), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.concat_ws(".", labels), F.lit(SEP), path)


def rule_table(rules: DataFrame) -> DataFrame:
    """(key, rule, action, depth, size, stack): every rule with the keys of the rules around it, outermost first.

    The rules around a rule are found by an equi-join of its key's proper
    prefixes with the rules' keys.
    """
    r = rules.where("host is not null and path is not null").select(
        _key(F.reverse(F.split("host", r"\.")), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "action",
        F.size(F.split("host", r"\.")).alias("depth")).groupBy("key", "rule", "depth").agg(F.max("action").alias("action"))
    starts = r.select(F.col("key").alias("inner"), F.explode(F.sequence(
        F.locate(SEP, F.col("key")), F.length("key"))).alias("n")).select("inner", F.expr("substring(inner, 1, n)").alias("key"))
    around = starts.join(r, "key").groupBy("inner").agg(F.sort_array(F.collect_list(F.struct(
        F.length("key").alias("n"), F.col("key"), F.col("rule"), F.col("action")))).alias("stack"))
    return r.join(around, r.key == around.inner).select(r.key, "depth", "stack")


def match_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """(url, host, path, rule, verdict) for every distinct url.

    Probes and rules are range-partitioned by key and written with their range's
    number.  Within a range a window carries the last rule's stack forward; what
    the last rule before a range is comes from one row per range.  A hot host
    splits, as ranges are cut by the whole key.
    """
    spark = urls.sparkSession
    ruled = cut_lineage(rule_table(rules), "url-rules")
    deepest = ruled.agg(F.max("depth")).first()[0] or 0
    u = F.col("url")
    judged = urls.select(F.col(url_col).alias("url")).distinct().withColumn("host", url_host(u)).withColumn("path", url_path(u))
    labels = F.reverse(F.split("host", r"\."))
    probes = judged.where("host <> ''").withColumn("labels", labels).withColumn("n", F.explode(F.expr(
        f"sequence(1, least({max(deepest, 1)}, size(labels)))"))).select(
        _key(F.expr("slice(labels, 1, n)"), F.col("path")).alias("key"), F.lit(1).alias("kind"), "url",
        F.lit(None).cast(ruled.schema["stack"].dataType).alias("stack"))
    events = probes.unionByName(ruled.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), "stack"))
    events = cut_lineage(events.repartitionByRange(4 * shuffle_partitions(spark), "key", "kind", "url")
                         .withColumn("range", F.spark_partition_id()), "url-events")
    ends = events.groupBy("range").agg(F.max(F.when(F.col("kind") == 0, F.col("key"))).alias("key"))  # one row per range
    ends = ends.join(ruled.select("key", F.col("stack").alias("end")), "key", "left").select("range", "end")
    carried = ends.select("range", F.last("end", ignorenulls=True).over(
        Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))  # rows: the number of ranges
    w = Window.partitionBy("range").orderBy("key", "kind", "url").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("last", F.last("stack", ignorenulls=True).over(w)).where("kind = 1") \
        .join(carried, "range").withColumn("last", F.coalesce("last", "carried"))
    active = swept.select("url", F.explode(F.filter("last", lambda s: F.col("key").startswith(s["key"]))).alias("s"))
    best = active.groupBy(F.col("url").alias("hit")).agg(F.max(F.struct(
        F.length("s.rule").alias("n"), F.col("s.key"), F.col("s.rule").alias("rule"), F.col("s.action").alias("action"))).alias("b"))
    return judged.join(best, judged.url == best.hit, "left").select(
        "url", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.action", F.lit(default)).alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) per row; the longest fitting rule wins, else ``default``."""
    verdicts = match_urls(pages, rules, url_col, default)
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("_url"))
    return rows.join(verdicts, rows["_url"].eqNullSafe(verdicts["url"])).select(id_col, "host", "path", "rule", "verdict")
