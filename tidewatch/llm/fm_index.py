"""Removal of word passages that occur earlier in the corpus, by compressed FM-indexes.

Every document is cut into segments: maximal runs of windows (of ``window``
words) that have the same anchor, the first ``anchor_words``-gram of least hash
in them.  Equal windows have equal anchors at equal places, so no segment holds a
window twice, a window's other occurrences lie in segments of its anchor
only, and shards are sets of anchors.  Equal segments collapse to their first
occurrence before any text moves.  Per shard, a compressed FM-index (wavelet
matrix over the Burrows-Wheeler transform of the segments' words, suffixes in
the order of their first ``window`` words, ties in text order) is built, the
shard's segments are streamed against it, and backward search gives, for every
window, the rows that start with it; the first of them is the window's earliest
occurrence.  Windows with an earlier occurrence are reported as spans of words.

An anchor with more than ``crowd`` different segments (a phrase that many
unlike documents hold) would fill a shard by itself: its windows are dealt out
one by one instead, each as a segment of its own, which again collapse to their
first occurrence.

Defined cases: words are runs of anything but space and U+0009 - U+000D, taken
unchanged; null and empty texts have none; null ids come before all others;
different texts of one id are documents in the order of a hash of their texts,
and rows that repeat both are one document and get equal results; an empty table
gives no row; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

from .common import LOWEST, batch_rows, ship

ship(__name__)

BYTES = 4_000_000  # text that is hashed at once
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self, base: int):
        self.steps = (np.uint64(base), np.uint64(pow(base, -1, 1 << 64)))
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int):
        if n > len(self.up):
            for name, step in zip(("up", "down"), self.steps):
                x = np.full(2 * n, step)
                x[0] = 1
                setattr(self, name, x.cumprod(dtype=np.uint64))

    def sums(self, x):
        """Prefix sums of ``x`` weighted by position; ``between`` reads hashes of slices off them."""
        self.reach(len(x) + 1)
        return np.concatenate([np.zeros(1, np.uint64), (x * self.up[:len(x)]).cumsum(dtype=np.uint64)])

    def between(self, sums, a, b):
        return mix((sums[b] - sums[a]) * self.down[a] + (b - a).astype(np.uint64))


class Words:
    """Hashes of the words of consecutive texts."""

    def __init__(self):
        self.sep = np.zeros(256, bool)
        self.sep[[32, *range(9, 14)]] = True
        self.bytes, self.words = Powers(BASE), Powers(MIX[1])

    def __call__(self, texts: list[bytes]):
        """(hash per word, number of its text per word)."""
        ends = np.cumsum([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        word = ~self.sep[data]
        fresh = np.zeros(len(data) + 1, bool)  # a text starts here
        fresh[0] = True
        fresh[ends] = True
        before = np.concatenate([[False], word[:-1]])
        after = np.concatenate([word[1:], [False]])
        starts = np.flatnonzero(word & (~before | fresh[:-1]))
        stops = np.flatnonzero(word & (~after | fresh[1:])) + 1
        hashes = self.bytes.between(self.bytes.sums(mix(data.astype(np.uint64) + np.uint64(1))), starts, stops)
        return hashes, np.searchsorted(ends, starts, "right")


def sliding_argmin(x, width: int):
    """Place of the first minimum of every ``width`` consecutive values."""
    size, at = 1, np.arange(len(x))
    while size < width:
        step = min(size, width - size)
        a, b = at[:len(at) - step], at[step:]
        at = np.where(x[b] < x[a], b, a)
        size += step
    return at


def cut_segments(hashes, owner, powers: Powers, window: int, anchor_words: int):
    """Segments of the texts' windows as (first word, windows, anchor, digest of the words)."""
    n = len(hashes)
    if n < window:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    sums = powers.sums(hashes)
    at = np.arange(n - anchor_words + 1)
    grams = powers.between(sums, at, at + anchor_words)
    least = sliding_argmin(grams, window - anchor_words + 1)
    start = np.flatnonzero(owner[:n - window + 1] == owner[window - 1:])
    least = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) != 1) | (least[1:] != least[:-1])
    head = np.flatnonzero(new)
    first, length = start[head], np.diff(np.append(head, len(start)))
    return first, length, grams[least[head]], powers.between(sums, first, first + length + window - 1)


class WaveletMatrix:
    """Rank over a sequence of small integers: one bit vector per binary digit, each with sampled counts."""

    def __init__(self, x, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            one = (x >> level & 1).astype(bool)
            packed = np.zeros((len(x) // 64 + 1) * 8, np.uint8)
            packed[:(len(x) + 7) // 8] = np.packbits(one, bitorder="little")
            words = packed.view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int32)
            zeros = len(x) - int(one.sum())
            self.levels.append((level, words, counts, zeros))
            x = np.concatenate([x[~one], x[one]])

    def descend(self, symbol, i):
        """Where positions ``i`` come to stand among the equal symbols behind the last digit."""
        for level, words, counts, zeros in self.levels:
            block = i >> 6
            ones = counts[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(symbol >> level & 1, zeros + ones, i - ones)
        return i


class FMIndex:
    """Compressed index of a text of integers (0 separates passages) for patterns of up to ``window`` symbols.

    Rows are the text's suffixes in the order of their first ``window`` symbols,
    ties by position, so the first row of a full window is its first occurrence.
    """

    def __init__(self, text, sigma: int, window: int):
        n = len(text)
        self.window, self.n = window, n
        rank, ranks, size = text.astype(np.int64), {1: text.astype(np.int64)}, 1
        while 2 * size <= window:
            rank = self._ranks(self._paired(rank, rank, size))
            size *= 2
            ranks[size] = rank
        done = size
        for s in sorted(ranks, reverse=True):  # the binary digits of the rest
            if window - done >= s:
                rank = self._ranks(self._paired(rank, ranks[s], done))
                done += s
        self.rows = np.argsort(rank, kind="stable").astype(np.int32)
        sorted_rank = rank[self.rows]
        new = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
        at = np.flatnonzero(new)
        kind = np.cumsum(new) - 1
        self.first = at[kind].astype(np.int32)                          # first and last row of a row's window
        self.stop = np.append(at[1:], n)[kind].astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.bwt = WaveletMatrix(text[self.rows - 1].astype(np.int64), max(1, int(sigma - 1).bit_length()))
        symbols = np.arange(sigma)
        self.base = self.bwt.descend(symbols, np.zeros(sigma, np.int64))

    @staticmethod
    def _paired(a, b, shift: int):
        low = np.zeros(len(a), np.int64)
        if shift < len(a):
            low[:-shift] = b[shift:] + 1
        return a * (int(b.max(initial=0)) + 2) + low

    @staticmethod
    def _ranks(keys):
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        out = np.empty(len(keys), np.int64)
        out[order] = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]]))
        return out

    def extend(self, symbol, lo, hi):
        """Rows that start with ``symbol`` before what rows lo .. hi - 1 start with."""
        base, before = self.base[symbol], self.before[symbol]
        return before + self.bwt.descend(symbol, lo) - base, before + self.bwt.descend(symbol, hi) - base

    def matches(self, text, start, length):
        """Streams passages of ``text`` (first symbol, number of windows) backwards through the index.

        Yields (passage numbers, window starts, first rows, numbers of rows) per
        step.  Matching statistics are kept up to the window: a match of
        ``window`` symbols that is extended to the left forgets its last symbol,
        whose rows then are all rows of the new window.  Where a match breaks, the
        next window is searched from its end.
        """
        who = np.arange(len(start))
        end = start + length - 1 + self.window       # behind the current window
        depth = np.zeros(len(start), np.int64)
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        while len(who):
            symbol = text[end - depth - 1]
            a, b = self.extend(symbol, lo, hi)
            found = b > a
            full = depth == self.window
            grown = np.where(full, depth, depth + 1)
            end = np.where(full, end - 1, end)
            whole = found & (grown == self.window)
            row = np.minimum(a, self.n - 1)
            a, b = np.where(whole, self.first[row], a), np.where(whole, self.stop[row], b)
            if whole.any():
                yield who[whole], end[whole] - self.window, a[whole], (b - a)[whole]
            broken = ~found                            # this window does not occur: on with the one before it
            end = np.where(broken, np.where(full, end, end - 1), end)
            depth = np.where(broken, 0, grown)
            lo, hi = np.where(broken, 0, a), np.where(broken, self.n, b)
            left = np.where(broken, end - self.window >= start[who], (depth < self.window) | (end - self.window > start[who]))
            who, end, depth, lo, hi = who[left], end[left], depth[left], lo[left], hi[left]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, v, text): the id, the same with the lowest number for null, 27 bits of the text's hash, the text."""
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return named.select("id", F.coalesce("id", F.lit(LOWEST)).alias("doc"),
                        F.shiftrightunsigned(F.xxhash64("text"), 37).alias("v"), "text")


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, anchor_words: int = 5) -> DataFrame:
    """(doc, place, anchor, digest): one row per segment; ``place`` packs the text's hash, the first word and the windows
    (as many as there are word grams in a window at most, below 32)."""
    if not 0 < window - anchor_words < 31:
        raise ValueError("windows must be 1 to 30 words longer than anchors")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = Words()
        for batch in batches:
            doc, v = (np.array(batch.column(c), dtype=np.int64) for c in ("doc", "v"))
            for rows, texts in by_bytes(batch.column("text")):
                hashes, owner = words(texts)
                first, length, anchor, digest = cut_segments(hashes, owner, words.words, window, anchor_words)
                if len(first):
                    begin = np.searchsorted(owner, np.arange(len(texts)))
                    mine = owner[first]
                    place = v[rows][mine] << 36 | (first - begin[mine]) << 5 | length
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                        doc[rows][mine], place, anchor.view(np.int64), digest.view(np.int64))], names=["doc", "place", "anchor", "digest"])

    return _keyed(docs, id_col, text_col).drop("id").mapInArrow(run, "doc long, place long, anchor long, digest long")


def by_bytes(column):
    """(row numbers, texts in UTF-8) in slices of about ``BYTES``."""
    rows, texts, size = [], [], 0
    for i, t in enumerate(column):
        raw = t.as_py().encode("utf-8", "surrogatepass")
        rows.append(i)
        texts.append(raw)
        size += len(raw)
        if size >= BYTES:
            yield np.array(rows), texts
            rows, texts, size = [], [], 0
    if rows:
        yield np.array(rows), texts


START = "cast(shiftright(place, 5) & 2147483647L as long)"
COUNT = "cast(place & 31L as int)"
VERSION = "shiftright(place, 36)"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, anchor_words: int = 5,
                   crowd: int = 2000, shard_words: int = 400_000) -> DataFrame:
    """(doc, v, start, stop): spans of words whose windows all occur earlier."""
    spark = docs.sparkSession
    with batch_rows(spark, 500):
        seg = cut_lineage(segments(docs, id_col, text_col, window, anchor_words), "segments")
    # what is joined back is written first, so that the joins have exchanges of their own and hot keys are split
    again = cut_lineage(seg.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    seg = cut_lineage(seg.join(again, "anchor", "left_semi"), "repeated-anchors")

    # equal segments: all but the first occurrence are repeats as a whole
    first = F.min(F.struct("doc", "place"))
    kinds = cut_lineage(seg.groupBy("anchor", "digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "segment-kinds")
    copies = seg.join(kinds.where("n > 1").select("anchor", "digest", "first"), ["anchor", "digest"]) \
        .where("doc <> first.doc or place <> first.place") \
        .selectExpr("doc", f"{VERSION} as v", f"{START} as start", f"{START} + {COUNT} + {window - 1} as stop")

    # anchors of several kinds of segments: the kinds' words go to shards
    several = cut_lineage(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "several")
    wanted = kinds.join(several, "anchor").selectExpr("first.doc as doc", "first.place as place", "anchor", f"kinds > {crowd} as crowded")
    size = wanted.agg(F.sum(F.expr(f"{COUNT} + {window}"))).first()[0] or 0
    shards = max(1, -(-size // shard_words))
    lists = wanted.selectExpr("doc", f"{VERSION} as v", "place", f"if(crowded, -1, pmod(xxhash64(anchor), {shards})) as shard") \
        .groupBy("doc", "v").agg(F.collect_list(F.struct("place", "shard")).alias("segments"))

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = Words()
        for batch in batches:
            for doc, v, text, parts in zip(*(batch.column(c) for c in ("doc", "v", "text", "segments"))):
                hashes, _ = words([text.as_py().encode("utf-8", "surrogatepass")])
                doc, v, parts = doc.as_py(), v.as_py(), parts.values
                place, shard = (np.array(parts.field(c), dtype=np.int64) for c in ("place", "shard"))
                start, n = place >> 5 & 0x7FFFFFFF, place & 31
                many = shard < 0
                rep = np.repeat(np.flatnonzero(many), n[many])          # one row per window of a crowded anchor
                at = start[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
                sums = words.words.sums(hashes)
                key = words.words.between(sums, at, at + window).view(np.int64)
                few = np.flatnonzero(~many)
                blobs = [hashes[start[i]:start[i] + n[i] + window - 1].tobytes() for i in few] + [b""] * len(at)
                start, shard = np.concatenate([start[few], at]), np.concatenate([shard[few], np.full(len(at), -1)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard), pa.array(np.concatenate([np.zeros(len(few), np.int64), key])), pa.array(np.full(len(start), doc)),
                    pa.array(np.full(len(start), v)), pa.array(start), pa.array(blobs, pa.binary())],
                    names=["shard", "key", "doc", "v", "start", "words"])

    with batch_rows(spark, 200):
        held = _keyed(docs, id_col, text_col).join(lists, ["doc", "v"]).dropDuplicates(["doc", "v"])
        held = cut_lineage(held.mapInArrow(gather, "shard long, key long, doc long, v long, start long, words binary"), "shards")
    found = held.where("shard >= 0").groupBy("shard").applyInArrow(_searcher(window), "doc long, v long, start long, stop long")
    alone = held.where("shard < 0").select("key", "doc", "v", "start")
    lead = alone.groupBy("key").agg(F.min(F.struct("doc", "v", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    lead = cut_lineage(lead, "window-firsts")
    single = alone.join(lead, "key").where("struct(doc, v, start) <> first").selectExpr("doc", "v", "start", f"start + {window} as stop")
    return copies.unionByName(found).unionByName(single)


def _searcher(window: int):
    """Arrow function: a shard's segments to spans of windows that occur earlier."""

    def search(key, shard):
        import pyarrow as pa

        doc, v, start = (np.array(shard.column(c), dtype=np.int64) for c in ("doc", "v", "start"))
        order = np.lexsort((start, v, doc))
        blobs = shard.column("words").to_pylist()
        parts = [np.frombuffer(blobs[i], np.uint64) for i in order]
        doc, v, start = doc[order], v[order], start[order]
        length = np.array([len(p) for p in parts])
        alphabet, codes = np.unique(np.concatenate(parts), return_inverse=True)
        begin = np.cumsum(length + 1) - length - 1
        text = np.zeros(int((length + 1).sum()), np.int64)
        text[np.arange(len(codes)) + np.repeat(np.arange(len(parts)), length)] = codes + 1
        index = FMIndex(text, len(alphabet) + 1, window)
        who, at = [], []
        for passage, where, row, rows in index.matches(text, begin, length - window + 1):
            first = index.rows[row]
            early = (rows > 1) & (first < where)  # passages stand in the order of their documents
            who.append(passage[early])
            at.append((start[passage] + where - begin[passage])[early])
        who, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, at))
        order = np.lexsort((at, who))
        who, at = who[order], at[order]
        new = np.ones(len(who), bool)
        new[1:] = (np.diff(who) != 0) | (np.diff(at) != 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(who)) - 1 if len(head) else head
        return pa.table({"doc": doc[who[head]], "v": v[who[head]], "start": at[head], "stop": at[tail] + window})

    return search


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, **options) -> DataFrame:
    """One row per document: (id_col, n_words, n_removed, kept): the words that no repeated window covers, joined by one space."""
    spark = docs.sparkSession
    spans = repeated_spans(docs, id_col, text_col, window, **options).distinct()
    lists = spans.groupBy("doc", "v").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = _keyed(docs, id_col, text_col).join(lists, ["doc", "v"], "left").select("id", "text", "spans")

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                stay = np.ones(len(words), bool)
                if spans.is_valid:
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, np.array(spans.values.field("start")), 1)
                    np.add.at(step, np.array(spans.values.field("stop")), -1)
                    stay = step.cumsum()[:-1] == 0
                n_words.append(len(words))
                n_removed.append(len(words) - int(stay.sum()))
                kept.append(b" ".join(w for w, s in zip(words, stay.tolist()) if s))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    with batch_rows(spark, 500):
        return joined.mapInArrow(keep, f"`{id_col}` long, n_words long, n_removed long, kept string")
