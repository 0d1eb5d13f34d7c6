import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import mixing, packing, queries


def poisson(u, rate):
    k, p, cdf = 0, math.exp(-rate), math.exp(-rate)
    while cdf < u and k < rate + 12 * rate ** 0.5 + 24:
        k += 1
        p *= rate / k
        cdf += p
    return k


def test_poisson_inverse(spark):
    cases = [(u, r) for r in (0.01, 0.7, 1.0, 4.2, 60.0) for u in (1e-9, 0.2, 0.5, 0.9, 0.999999)] + [(0.5, 0.0)]
    got = spark.createDataFrame(cases, "u double, r double").withColumn("k", mixing.poisson_inverse(F.col("u"), F.col("r"))).collect()
    assert [r.k for r in got] == [poisson(u, r) if r else 0 for u, r in cases]


def test_replication_against_plain_python(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", f"t{i}") for i in range(400)]
    got = mixing.replicate(spark.createDataFrame(rows, "doc_id long, source string, copy string"), weights={"hot": 1, "s0": 3, "s1": 1})
    assert set(got.columns) == {"doc_id", "source", "copy", "shuffle_key"}
    n = Counter(s for _, s, _ in rows)
    w = {"hot": 1, "s0": 3, "s1": 1}
    share = sum(w.get(s, 0) for s in n)
    want = Counter()
    for i, s, _ in rows:
        u = (int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        rate = len(rows) * w.get(s, 0) / share / n[s]
        want[i] = poisson(u, rate) if rate else 0
    assert Counter(r.doc_id for r in got.collect()) == +want


def test_replication_edges(spark):
    df = spark.createDataFrame([(None, None), (1, None), (1, None), (2, "a")], "doc_id long, source string")
    got = mixing.replicate(df, target_rows=40).collect()
    per = Counter((r.doc_id, r.source) for r in got)
    assert per[(1, None)] % 2 == 0 and per[(2, "a")] > 0
    assert mixing.replicate(df.where("false")).count() == 0
    assert mixing.replicate(df, weights={}).count() == 0


def test_copies_are_shuffled(spark, sf_dir):
    got = queries.op10_source_mixing(spark, sf_dir).select("doc_id", "copy").collect()
    assert [r.doc_id for r in got] != sorted(r.doc_id for r in got)
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 6000])
def test_piece_lengths(n):
    got = packing.piece_lengths(n, 2048)
    assert sum(got) == n and all(k & (k - 1) == 0 and k <= 2048 for k in got)
    assert len(got) == n // 2048 + bin(n % 2048).count("1")


def tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids + [1]


def test_pieces_are_the_tokenizers_ids(spark):
    texts = ["", None, "Hello  world", "tail <|endoftext|> in text", "ß" * 5000, "a b\n\n c\t", "x" * 30_000, "naïve Ünï 漢字 🙂 123'll"]
    df = spark.createDataFrame([(2 ** 60 + i, t, 5) for i, t in enumerate(texts)] + [(None, "no id", 1)], "doc_id long, text string, length int")
    got = {}
    for r in packing.pack(df).orderBy("doc_id", "start").collect():
        assert r.offset == 0 and r.length == len(r.tokens) // 4
        ids = got.setdefault(r.doc_id, [])
        assert r.start == len(ids)
        ids.extend(np.frombuffer(r.tokens, "<u4").tolist())
        got.setdefault(("n", r.doc_id), r.doc_tokens)
    for i, t in enumerate(texts):
        assert got[2 ** 60 + i] == tokens(t or "") and got[("n", 2 ** 60 + i)] == len(got[2 ** 60 + i])
    assert got[None] == tokens("no id")
    assert packing.pack(df.where("false")).count() == 0


def test_packing_query_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op8_packing(spark, sf_dir).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        ids = np.array(tokens(docs[r.doc_id])[r.start:r.start + r.length], "<u4") if r.doc_id % 9 == 0 else None
        assert ids is None or zlib.crc32(ids.tobytes()) == r.ids_crc32


def test_bucket_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words to pack"), (2, "more")], "doc_id long, text string")
    packing.write_buckets(packing.pack(df), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).agg(F.sum("length")).first()[0] == len(tokens("some words to pack")) + len(tokens("more"))


def test_window_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), window=1000)
