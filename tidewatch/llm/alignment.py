"""Cross-tokenizer alignment by interval coalescing.

A text is encoded by a byte-level vocabulary A (a space and the text) and a piece
vocabulary B (which adds the space itself); both sequences tile the same bytes.
All A and B tokens stand in the order of their first byte; where a token's start
reaches the running maximum of the ends before it, a group breaks, so a group is
the smallest run of bytes that both vocabularies cut out.  Within a group, every
A token links to the B tokens whose bytes overlap its own.

How many documents hold an id pair linked is counted over the corpus from the
distinct pairs of each document, pre-aggregated before the shuffle.

Defined cases: strings of special tokens inside texts are plain text; texts that
are null or empty, or whose joined B bytes differ from the space and the text,
have no tokens (zeros, empty digest); every row is a document of its own, so a
repeated row counts as often as it occurs; a null id stays null; an empty table
gives no row; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

from .common import batch_rows, ship

ship(__name__)

BYTES = 400_000          # text that is aligned at once
BROADCAST_ROWS = 2_000_000  # pairs up to which the table of counts is broadcast


class Vocabularies:
    """Ids and bytes of the two vocabularies' tokens."""

    def __init__(self, ranks: str, pieces: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_size, self.b_size = max(table.values()) + 1, self.b.get_piece_size()
        self.a_length = np.zeros(self.a_size, np.int64)
        for raw, i in table.items():
            self.a_length[i] = len(raw)
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode("utf-8") for i in range(self.b_size)]
        self.b_length = np.array([len(x) for x in self.b_bytes])
        # an id's decimal text with what follows it: , | or ;
        self.written = [f"{i}{mark}" for size in (self.a_size, self.b_size) for i in range(size) for mark in ",|;"]

    def encode(self, texts: list[str]):
        """Lists of A ids and of B ids per text, both empty where a text has no tokens."""
        found_a, found_b = [], []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1) if texts else []):
            raw = b" " + text.encode("utf-8")
            a = self.a.encode_ordinary(" " + text)
            same = bool(text) and b"".join(map(self.b_bytes.__getitem__, b)) == raw and int(self.a_length[a].sum()) == len(raw)
            found_a.append(a if same else [])
            found_b.append(b if same else [])
        return found_a, found_b


def coalesce(a_length, b_length):
    """Groups and links of two sequences of lengths that tile the same range.

    Returns (kind, number) of all tokens in the groups' order (A before B in a
    group), their group, and the linked A and B token numbers.
    """
    a_end, b_end = a_length.cumsum(), b_length.cumsum()
    a_start, b_start = a_end - a_length, b_end - b_length
    kind = np.repeat(np.arange(2), [len(a_end), len(b_end)])
    number = np.concatenate([np.arange(len(a_end)), np.arange(len(b_end))])
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((kind, start))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = fresh.cumsum() - 1
    order = np.argsort(group * 2 + kind, kind="stable")  # two ascending runs: merged in linear time
    # overlaps: B tokens that end behind an A token's start and start before its end
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    fan = high - low
    link_a = np.repeat(np.arange(len(a_end)), fan)
    link_b = np.arange(len(link_a)) - np.repeat(fan.cumsum() - fan - low, fan)
    return kind[order], number[order], group[order], link_a, link_b


def slices(column):
    """Lists of texts of about ``BYTES`` in all, in order."""
    texts, size = [], 0
    for t in column:
        texts.append(t.as_py())
        size += len(texts[-1])
        if size >= BYTES:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def _flat(lists):
    out = np.fromiter((i for x in lists for i in x), np.int64, sum(map(len, lists)))
    return out, np.cumsum([len(x) for x in lists])


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = "byte_bpe_50k.tiktoken",
          pieces: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and its distinct linked pairs
    (arrays a, b, times).  File names are looked up among the public tokenizers on each worker."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        import public_tokenizers

        vocabularies = Vocabularies(public_tokenizers.path(ranks), public_tokenizers.path(pieces))
        for batch in batches:
            done = 0
            for texts in slices(batch.column("text")):
                n = len(texts)
                lists_a, lists_b = vocabularies.encode(texts)
                (a, a_to), (b, b_to) = _flat(lists_a), _flat(lists_b)
                kind, number, group, link_a, link_b = coalesce(vocabularies.a_length[a], vocabularies.b_length[b])
                owner_a = np.repeat(np.arange(n), np.diff(a_to, prepend=0))
                # what follows a token: , (0), | (1) or ; (2)
                mark = np.full(len(kind), 2)
                mark[:-1] = np.where(group[1:] != group[:-1], 2, (kind[1:] != kind[:-1]).astype(np.int64))
                ids = np.concatenate([a, b + vocabularies.a_size])[number + kind * len(a)]
                words = list(map(vocabularies.written.__getitem__, (ids * 3 + mark).tolist()))
                ends = (a_to + b_to).tolist()
                digests = [hashlib.sha256("".join(words[p:q])[:-1].encode()).hexdigest() if q > p else ""
                           for p, q in zip([0, *ends], ends)]
                heads = np.flatnonzero(np.diff(group, prepend=-1))           # a group starts with an A token
                n_groups = np.bincount(owner_a[number[heads]], minlength=n)
                n_links = np.bincount(owner_a[link_a], minlength=n)
                key = (owner_a[link_a] * vocabularies.a_size + a[link_a]) * vocabularies.b_size + b[link_b]
                key, times = np.unique(key, return_counts=True)
                pair_b, rest = key % vocabularies.b_size, key // vocabularies.b_size
                pair_a, own = rest % vocabularies.a_size, rest // vocabularies.a_size
                offsets = pa.array(np.searchsorted(own, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pair_a, pair_b, times)]
                count = lambda x: pa.array(np.diff(x, prepend=0).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, n), count(a_to), count(b_to), pa.array(n_groups),
                                                  pa.array(n_links), pa.array(digests), *lists],
                                                 names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"])
                done += n

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with batch_rows(docs.sparkSession, 500):
        return src.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                   "a array<int>, b array<int>, times array<int>")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = "byte_bpe_50k.tiktoken",
           pieces: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per group: doc_id, place (from 0), bytes (of the space and the text), a and b (token ids)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import public_tokenizers

        vocabularies = Vocabularies(public_tokenizers.path(ranks), public_tokenizers.path(pieces))
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                (a,), (b,) = vocabularies.encode([text])
                if not a:
                    continue
                a, b = np.array(a), np.array(b)
                kind, number, group, _, _ = coalesce(vocabularies.a_length[a], vocabularies.b_length[b])
                n = int(group[-1]) + 1
                cut = [np.searchsorted(group[kind == k], np.arange(n + 1)).astype(np.int32) for k in (0, 1)]
                size = np.add.reduceat(vocabularies.a_length[a], cut[0][:-1])
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc] * n, pa.int64()), pa.array(np.arange(n)), pa.array(size),
                    pa.ListArray.from_arrays(pa.array(cut[0]), pa.array(a.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cut[1]), pa.array(b.astype(np.int32)))], names=["doc_id", "place", "bytes", "a", "b"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with batch_rows(docs.sparkSession, 500):
        return src.mapInArrow(run, "doc_id long, place long, bytes long, a array<int>, b array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): documents that hold the pair linked; whether no pair of that A id has more."""
    held = aligned.select(F.explode(F.arrays_zip("a", "b")).alias("p")).select("p.a", "p.b")
    counts = cut_lineage(held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, **files) -> DataFrame:
    """``align``'s columns without the pairs, with n_best and count_sum over the document's links.

    The table of pair counts is broadcast up to ``broadcast_rows`` rows; beyond
    that, the documents' distinct pairs are joined to it by shuffle.
    """
    aligned = align(docs, id_col, text_col, **files).withColumn("row", F.monotonically_increasing_id())
    aligned = cut_lineage(aligned, "aligned")
    pairs = cut_lineage(pair_counts(aligned), "pairs")
    small = pairs.count() <= broadcast_rows
    held = aligned.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("row", "p.a", "p.b", "p.times")
    told = held.join(F.broadcast(pairs) if small else pairs, ["a", "b"])
    sums = told.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                   F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left").select(
        F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
