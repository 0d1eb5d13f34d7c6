"""Near-duplicate documents by DartMinHash signatures and banded joining.

A text is the weighted set of its five-word shingles, the weight being a
shingle's count.  Hashed darts fall on the region of every element (weight by
rank, the weight axis cut into parts of doubling width); a dart counts if it
lies below the element's weight, and each of the signature's coordinates keeps
its dart of earliest rank.  Two texts agree in a coordinate with the probability
of their weighted Jaccard likeness.

Texts that share a band of coordinates meet in a bucket; each bucket links its
members to pivots, every link is verified on the whole texts, and verified links
are united.  Members of one bucket that are still in different classes after the
pivot rounds are joined exactly on their rarest shingles, so no link is lost to
the pivots.

Defined cases: words are lower-cased runs between white space; a text of one to
four words is one shingle; null texts and texts without a word link with
nothing; null ids link with nothing and have a null class; equal texts are one
member; an id with several texts joins their classes; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.session import cut_lineage

from .common import batch_rows, components, joined_components, ship

ship(__name__)

#: A member is one row of its text: the document's id and a hash of the text as it stands.
MEMBER = "struct<doc:bigint,row:bigint>"

MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def _unit(h):
    """Hashes to doubles in (0, 1)."""
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0 ** -52


class Shingles:
    """Distinct shingle hashes of a text with their counts."""

    def __init__(self, words: int = 5):
        self.words = words
        self.base = np.uint64(0x100000001B3)
        self.inverse = np.uint64(pow(0x100000001B3, -1, 1 << 64))
        self._grow(1 << 12)

    def _grow(self, n: int):
        with np.errstate(over="ignore"):
            self.up = np.concatenate([np.ones(1, np.uint64), np.full(n, self.base)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([np.ones(1, np.uint64), np.full(n, self.inverse)]).cumprod(dtype=np.uint64)

    def __call__(self, text: str):
        data = " ".join(text.lower().split()).encode("utf-8", "surrogatepass")
        if not data:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        b = np.frombuffer(data, dtype=np.uint8)
        if len(b) >= len(self.up):
            self._grow(2 * len(b))
        gaps = np.flatnonzero(b == 32)
        starts = np.concatenate([[0], gaps + 1])
        ends = np.concatenate([gaps, [len(b)]])
        sums = np.concatenate([np.zeros(1, np.uint64), (_mix(b.astype(np.uint64) + np.uint64(1)) * self.up[:len(b)]).cumsum(dtype=np.uint64)])
        word = _mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        if len(word) < self.words:
            word = np.concatenate([word, np.zeros(self.words - len(word), np.uint64)])
        n = len(word) - self.words + 1
        h = np.zeros(n, np.uint64)
        for j in range(self.words):
            h = _mix(h * np.uint64(MIX[0]) + word[j:j + n])
        return np.unique(h, return_counts=True)


def dart_signatures(sets: list, k: int, seed: int = 0):
    """(len(sets), k) uint64: per set and coordinate the earliest dart's number.

    ``sets`` holds (element hashes, positive weights) pairs, none empty.  Darts of
    an element's part of width 2^v have exponential gaps of mean 2^-v along the
    rank axis; they are followed up to a rank where about k ln k + 2k darts count
    in all, and sets with an empty coordinate are thrown again up to twice that.
    """
    out = np.zeros((len(sets), k), np.uint64)
    todo = np.arange(len(sets))
    factor = 1.0
    while len(todo):
        sizes = np.array([len(sets[i][0]) for i in todo])
        elements = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([sets[i][1] for i in todo]).astype(np.float64)
        owner = np.repeat(np.arange(len(todo)), sizes)
        limit = factor * (k * np.log(k) + 2 * k) / np.bincount(owner, weights, len(todo))
        parts = np.frexp(weights + 1.0)[1].astype(np.int64)  # parts 0 .. parts - 1 start below the weight,
        parts -= 2.0 ** (parts - 1) - 1 >= weights           # but for one that starts at it
        rep = np.repeat(np.arange(len(elements)), parts)
        level = np.arange(len(rep)) - np.repeat(np.cumsum(parts) - parts, parts)
        width = 2.0 ** level
        cell = _mix(elements[rep] * np.uint64(MIX[0]) + level.astype(np.uint64) * np.uint64(MIX[1]) + np.uint64(seed * 2 + 1))
        top, owner = weights[rep], owner[rep]
        live, rank, bound = np.arange(len(rep)), np.zeros(len(rep)), limit[owner]
        best = np.full(len(todo) * k, np.inf)
        slots, ranks, numbers, step = [], [], [], 0
        while len(live):
            h = _mix(cell[live] + np.uint64((step + 1) * MIX[0] % (1 << 64)))
            rank = rank - np.log(_unit(h)) / width[live]
            near = rank < bound
            live, rank, bound, h = live[near], rank[near], bound[near], _mix(h[near] ^ np.uint64(MIX[2]))
            inside = width[live] - 1 + _unit(h) * width[live] < top[live]
            d = _mix(h[inside] + np.uint64(MIX[1]))
            slot = owner[live[inside]] * k + (d % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, slot, rank[inside])
            slots.append(slot)
            ranks.append(rank[inside])
            numbers.append(d)
            step += 1
        slot, rank, d = np.concatenate(slots), np.concatenate(ranks), np.concatenate(numbers)
        first = rank == best[slot]
        found = np.zeros(len(todo) * k, np.uint64)
        found[slot[first]] = d[first]
        out[todo] = found.reshape(-1, k)
        todo = todo[np.isinf(best).reshape(-1, k).any(axis=1)]
        factor *= 2
    return out


def in_blocks(sets: list, elements: int = 200_000):
    """Consecutive slices of ``sets`` of about so many elements each."""
    start = size = 0
    for i, (e, _) in enumerate(sets):
        size += len(e)
        if size >= elements:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sets):
        yield start, len(sets)


def likeness(a, b) -> float:
    """Weighted Jaccard likeness of (sorted hashes, counts) pairs."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    low = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def _member(id_col: str, text_col: str):
    """The (doc, row) struct of a document row."""
    return F.struct(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("row"))


def member_texts(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): one row for each of the ``members`` (id), however often the table repeats it.

    The only pass that deals out whole documents: always by shuffle, whatever
    the sizes; links are verified on the members' texts alone.
    """
    return docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(_member(id_col, text_col).alias("id"), F.col(text_col).alias("text")) \
        .join(members.hint("merge"), "id", "left_semi").dropDuplicates(["id"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = 20, rows: int = 4,
               words: int = 5) -> DataFrame:
    """(id, key, size, bands): member, text digest, shingle count, one hash per band.

    Rows with a null id or without a word are left out.
    """
    k = bands * rows

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        shingles = Shingles(words)
        salt = _mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            at, keys, sets = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = shingles(text)
                if len(found[0]):
                    at.append(i)
                    sets.append(found)
                    keys.append(hashlib.blake2b(" ".join(text.lower().split()).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            sizes, hashes = [int(w.sum()) for _, w in sets], []
            for a, b in in_blocks(sets):
                sig = dart_signatures(sets[a:b], k)
                h = np.broadcast_to(salt, (b - a, bands))
                for j in range(rows):
                    h = _mix(h * np.uint64(MIX[0]) + sig[:, j::rows])
                hashes.extend(h.astype(np.int64))
            if at:
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(at)), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                    pa.array(hashes, pa.list_(pa.int64()))], names=["id", "key", "size", "bands"])

    src = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        _member(id_col, text_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {MEMBER}, key binary, size long, bands array<long>")


def rare_shingle_pairs(texts: DataFrame, members: DataFrame, threshold: float, words: int = 5) -> DataFrame:
    """(a, b) pairs of members (id, class) of different classes that can reach the likeness.

    Two texts of at least that likeness share ``threshold`` of either's shingles,
    so, with all texts' shingles in one order, they share one of the first
    ``size - ceil(threshold * size) + 1`` of each.  The order is by rising number
    of members that hold a shingle: passages that many texts share come last, and
    a text with enough shingles of its own has no partner at all.  At the first
    shingle that two texts share, what is left of either bounds what they can
    have in common; a shared shingle later than that bound allows gives no pair.
    """
    spark = texts.sparkSession
    texts = texts.join(members.select("id").hint("merge"), "id", "left_semi").select("id.doc", "id.row", "text")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingles = Shingles(words)
        for batch in batches:
            for doc, row, text in zip(batch.column("doc").to_pylist(), batch.column("row").to_pylist(), batch.column("text")):
                h, n = shingles(text.as_py())
                if len(h):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(h), doc)), pa.array(np.full(len(h), row)), pa.array(np.full(len(h), n.sum())),
                        pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], names=["doc", "row", "size", "h", "n"])

    with batch_rows(spark, 1000):
        held = cut_lineage(texts.mapInArrow(cut, "doc long, row long, size long, h long, n long"), "shingles")
    common = held.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1
    shared = held.join(common, "h")
    here = shared.groupBy("doc", "row").agg(F.sum("n").alias("shared_n"))
    # shingles of one holder come first; the rest is counted on from them
    w = Window.partitionBy("doc", "row").orderBy("df", "h").rowsBetween(Window.unboundedPreceding, -1)
    ranked = shared.join(here, ["doc", "row"]).withColumn("first", F.col("size") - F.col("shared_n")).where(F.col("first") < own) \
        .withColumn("before", F.col("first") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    prefix = ranked.where(F.col("before") < own).select(F.struct("doc", "row").alias("id"), "size", "h", "before")
    prefix = cut_lineage(prefix.join(members, "id"), "prefixes")
    x = prefix.select("h", *[F.col(c).alias(f"{c}_a") for c in ("id", "size", "class", "before")])
    y = prefix.select("h", *[F.col(c).alias(f"{c}_b") for c in ("id", "size", "class", "before")])
    low = F.lit(threshold)
    return x.join(y, "h").where("id_a < id_b and class_a <> class_b") \
        .where(F.least("size_a", "size_b") >= low * F.greatest("size_a", "size_b")) \
        .where(F.least(F.col("size_a") - F.col("before_a"), F.col("size_b") - F.col("before_b")) + 1e-6
               >= low / (1 + low) * (F.col("size_a") + F.col("size_b"))) \
        .select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def verify(pairs: DataFrame, texts: DataFrame, threshold: float, words: int = 5, fan: int = 200) -> DataFrame:
    """Those (a, b) pairs whose whole texts have at least the likeness.

    Texts are joined to the pairs by member; a member b with many partners is
    dealt out over copies, one for every ``fan`` partners.
    """
    pairs = pairs.select("a", "b")
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / fan).cast("int").alias("copies"))
    right = texts.join(many.hint("merge"), texts.id == many.b).select("b", F.col("text").alias("text_b"), F.explode(
        F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    left = pairs.join(many, "b").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")) \
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")

    def check(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingles = Shingles(words)
        last, seen = None, None
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("text_a"), batch.column("text_b")):
                tb = tb.as_py()
                if tb != last:  # rows of one b mostly follow each other
                    last, seen = tb, shingles(tb)
                keep.append(likeness(shingles(ta.as_py()), seen) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return left.join(right, ["b", "copy"]).select("a", "b", "text_a", "text_b").mapInArrow(check, f"a {MEMBER}, b {MEMBER}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                    bands: int = 20, rows: int = 4, words: int = 5, pivot_rounds: int = 4) -> DataFrame:
    """(id, component, links): class of every id that has a word; ids in no class are their own.

    ``links`` counts the verified links of an id's text.  In each pivot round a
    bucket has one pivot (the member of lowest rank for that round), so links
    grow with the members.  The first two rounds depend on nothing found before
    and are verified together; from the third round on only members take part that
    are not known to be of their pivot's class.
    """
    spark = docs.sparkSession
    with batch_rows(spark, 1000):
        sig = cut_lineage(signatures(docs, id_col, text_col, bands, rows, words), "signatures")
    groups = cut_lineage(sig.groupBy("key").agg(F.min("id").alias("rep")), "texts")
    reps = sig.join(groups, (sig.key == groups.key) & (sig.id == groups.rep), "left_semi").dropDuplicates(["id"])
    member = reps.select("id", "size", F.explode("bands").alias("bucket"))
    crowd = cut_lineage(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "crowded")
    member = cut_lineage(member.join(crowd, "bucket"), "buckets")
    texts = cut_lineage(member_texts(docs, member.select("id").distinct(), id_col, text_col), "member-texts")
    low = F.lit(threshold)

    def untried(pairs: DataFrame) -> DataFrame:
        if tried is None:
            return pairs
        return pairs.join(tried.union(tried.select("b", "a")), ["a", "b"], "left_anti")

    def verified(pairs: DataFrame) -> DataFrame:
        with batch_rows(spark, 200):
            return cut_lineage(verify(pairs, texts, threshold, words), "links")

    def near_labels() -> DataFrame:
        """(id, label): the least member within two links; equal labels are of one class."""
        both = links.select("a", "b").union(links.select("b", "a"))
        one = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("label"))
        one = cut_lineage(one, "labels")
        two = both.join(one.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        return one.join(two, one.id == two.a).select("id", F.least("label", "low").alias("label"))

    def unsettled_members(classes: DataFrame) -> DataFrame:
        """(id, size, bucket, class) of buckets whose members are not all of one class."""
        placed = member.join(classes.toDF("id", "found"), "id", "left").select("id", "size", "bucket", F.coalesce("found", "id").alias("class"))
        placed = cut_lineage(placed, "classes")
        split = placed.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("bucket")
        return placed.join(cut_lineage(split, "split"), "bucket")

    def lowest(turn: int, *more):
        return F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("r"), F.col("id"), F.col("size").alias("n"), *more))

    tried = links = None
    free = min(2, pivot_rounds)
    for turn in range(max(free - 1, 0), pivot_rounds):
        if turn < 2:  # nothing found before is needed: the pivots of these rounds in one pass, a pair by the first round that has it
            pivots = member.groupBy("bucket").agg(F.array(*[lowest(t) for t in range(free)]).alias("ps"))
            placed = member.join(pivots, "bucket").select("id", "size", F.posexplode("ps").alias("turn", "p")).where(F.col("id") != F.col("p.id"))
        else:  # members known to be of the pivot's class are settled with it
            unsettled = cut_lineage(unsettled_members(near_labels()), "unsettled")
            pivots = unsettled.groupBy("bucket").agg(lowest(turn, F.col("class")).alias("p"))
            placed = unsettled.join(pivots, "bucket").where(F.col("class") != F.col("p.class")).withColumn("turn", F.lit(turn))
        pairs = placed.select("turn", F.col("id").alias("a"), F.col("p.id").alias("b"), "size", F.col("p.n").alias("n")) \
            .where(F.least("size", "n") >= low * F.greatest("size", "n"))
        pairs = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")) \
            .agg(F.min(2 * F.col("turn") + (F.col("a") > F.col("b")).cast("int")).alias("k")) \
            .select(F.when(F.col("k") % 2 == 0, F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(F.col("k") % 2 == 0, F.col("hi")).otherwise(F.col("lo")).alias("b"))
        pairs = cut_lineage(untried(pairs), "pairs")
        good = verified(pairs)
        tried = pairs if tried is None else tried.union(pairs)
        links = good if links is None else links.union(good)

    # members of one bucket that are still in different classes: exact join on rare shingles
    classes = cut_lineage(components(links, "a", "b"), "components")
    unsettled = cut_lineage(unsettled_members(classes).select("id", "class").distinct(), "unsettled")
    if not unsettled.isEmpty():
        rest = cut_lineage(untried(rare_shingle_pairs(texts, unsettled, threshold, words)), "pairs")
        if not rest.isEmpty():
            more = verified(rest)
            links = links.union(more)
            classes = joined_components(classes, more, "a", "b")
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    named = groups.join(classes, groups.rep == classes.id, "left").join(degree, groups.rep == degree.id, "left") \
        .select("key", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    return sig.select("id.doc", "key").distinct().join(named, "key").groupBy(F.col("doc").alias("id")).agg(
        F.min("component.doc").alias("component"), F.max("links").alias("links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class stays, the one of smallest id; its columns are unchanged.

    Documents without a word or an id stay.  Of rows that repeat an id and its
    text one stays; an id with several texts keeps one row of each, or loses all
    of them where a smaller id has a text of their class.
    """
    classes = near_duplicates(docs, id_col, text_col, **options)
    gone = classes.where("component <> id").select(F.col("id").alias(id_col))
    named = docs.where(F.col(id_col).isNotNull()).join(gone, id_col, "left_anti").dropDuplicates([id_col, text_col])
    return named.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
