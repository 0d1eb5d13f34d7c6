"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces of the window's length and then, by
the binary digits of the rest, into falling powers of two.  Every piece is a
sequence by itself: equal lengths form a bucket, nothing is padded and no
sequence crosses documents.

Defined cases: null text is empty; an empty text gives one piece with the end
id alone; repeated rows are packed as often as they occur; further columns are
ignored; an empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

PIECES = "doc_id long, start long, length long, tokens binary, doc_tokens long"


def piece_lengths(n: int, window: int) -> list[int]:
    """Whole windows first, then the binary digits of the rest from the highest."""
    rest = n % window
    return [window] * (n // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _encoder(vocabulary: str, ranks: str | None):
    """Texts to ids of the vocabulary file, special tokens' strings as that file reads them.

    The rank file holds the same vocabulary for a faster encoder with equal ids
    (tested); texts with the special string go through the vocabulary file itself.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    whole = lambda t: exact.encode(t, add_special_tokens=False).ids
    if ranks is None:
        return whole
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    return lambda t: whole(t) if any(s in t for s in special) else fast.encode_ordinary(t)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1,
         vocabulary: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per piece: doc_id, start, length, tokens (little-endian uint32), doc_tokens, sequence_id, offset.

    ``window`` is a power of two.  File names are looked up among the public
    tokenizers on each worker.  One pass over the scan's partitions, no shuffle;
    ``sequence_id`` is the partition number and the row's place in it, so a task
    that is run again gives the same numbers.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")

    def run(batches: Iterator) -> Iterator:
        import os

        import numpy as np
        import pyarrow as pa
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoder(public_tokenizers.path(vocabulary), ranks and public_tokenizers.path(ranks))
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                            ("tokens", pa.binary()), ("doc_tokens", pa.int64())])

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array(encode(text) + [end_id], dtype="<u4")
                at, n = 0, len(ids)
                for k in piece_lengths(n, window):
                    rows.append((doc, at, k, ids[at:at + k].tobytes(), n))
                    at += k
                size += n
                if size >= 2_000_000:  # bounded output batches, whatever the texts' lengths
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    src = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(run, PIECES).select(
        "*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences with one folder per length (a curriculum reads the lengths it wants)."""
    pieces.write.mode("overwrite").partitionBy("length").parquet(path)
