"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a
text's shingles of five words.  Sketches of parts merge into the sketch of the
whole; two sketches estimate resemblance and containment, one the number of
distinct shingles.

Only DataFrame functions.  Defined cases: null text is empty; an empty text has
the empty sketch; a text of one to four words has one shingle; two empty
sketches have likeness 1, an empty one and another 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACE = float(2 ** 64)


def shingle_hashes(text: Column, words: int = 5) -> Column:
    """Hashes of all shingles, in text order, repeats included.

    Words are hashed once; a shingle's hash chains those of its words.  The word
    array is bound as a lambda variable, so it is made once per row.
    """
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    hashed = F.transform(F.split(clean, " "), lambda t: F.xxhash64(t))
    chain = lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))),
        lambda i: F.xxhash64(*[F.try_element_at(w, i + j) for j in range(words)]))
    rolled = F.transform(F.array(hashed), chain)[0]
    return F.when(clean == "", F.array().cast("array<bigint>")).otherwise(rolled)


def sketch(text: Column, k: int = 128, words: int = 5) -> Column:
    return bottom(shingle_hashes(text, words), k)


def bottom(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = 128) -> Column:
    """Sketch of the union."""
    return bottom(F.concat(a, b), k)


def merge_parts(df: DataFrame, key_cols: list[str], sketch_col: str, k: int = 128) -> DataFrame:
    """One sketch per key from those of its parts.

    Ranks at most k hashes per key and task before the shuffle (Spark's window
    group limit), so a key with many parts sends k hashes from each task.
    """
    each = df.select(*key_cols, F.explode_outer(sketch_col).alias("h")).distinct()
    w = Window.partitionBy(*key_cols).orderBy(F.col("h").asc_nulls_last())
    least = each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return least.groupBy(*key_cols).agg(F.sort_array(F.collect_list("h")).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated Jaccard likeness: the share of the union's bottom k that both sketches hold."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)) \
        .otherwise(both.cast("double") / F.greatest(F.size(merge(a, b, k)), F.lit(1)))


def distinct_shingles(a: Column, k: int = 128) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + SPACE / 2) / SPACE
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated share of a's shingles that b holds, from resemblance and the two counts."""
    r, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r / (1 + r) * (na + nb) / na))


def as_text(sketch_col: Column) -> Column:
    """Sixteen hexadecimal digits per hash."""
    return F.concat_ws("", F.transform(sketch_col, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))
