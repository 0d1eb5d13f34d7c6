"""Substring removal by FM-indexes against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidewatch.llm import fm_index, queries


def plain(rows, window=20):
    """{id: (n_words, n_removed, kept)} for rows of distinct ids."""
    first, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            if first.setdefault(tuple(words[i:i + window]), (doc, i)) != (doc, i):
                gone.update(range(i, i + window))
        out[doc] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def found(df):
    return {r[0]: tuple(r[1:4]) for r in df.collect()}


def corpus(rng, n):
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 4)))
    passage = [word() for _ in range(60)]
    line = [word() for _ in range(12)]
    rows = []
    for i in rng.sample(range(-50, 5000), n):
        words = [word() for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.5:
            at = rng.randrange(len(words) + 1)
            a = rng.randrange(0, 30)
            words[at:at] = passage[a:a + rng.randrange(15, 40)]
        if rng.random() < 0.5:
            words += line
        if rng.random() < 0.1:
            words += ["ha"] * rng.randrange(15, 90)
        if rng.random() < 0.1 and rows:
            words = rows[-1][1].split()
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("crowd", [2000, 1])
def test_remove_repeats_matches_plain(spark, crowd):
    rows = corpus(random.Random(4), 160) + [(None, "x " * 50), (9000, None), (9001, ""), (9002, " \n\t "), (9003, "a b " * 700)]
    df = spark.createDataFrame([(i, t, 1, "z", 0) for i, t in rows], "doc_id long, text string, v int, anchor string, spans int")
    got = found(fm_index.remove_repeats(df.repartition(7), crowd=crowd, shard_words=700))
    want = plain(rows)
    assert got == want
    assert sum(v[1] for v in want.values()) > 500


def test_remove_repeats_other_windows(spark):
    rows = corpus(random.Random(9), 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(fm_index.remove_repeats(df, window=7, anchor_words=3)) == plain(rows, 7)


def test_remove_repeats_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d " * 9), (1, "a b c d " * 9), (None, None), (None, None)], "doc_id long, text string")
    rows = sorted(fm_index.remove_repeats(df).collect(), key=str)
    assert len(rows) == 4 and rows[0] == rows[1] and rows[2] == rows[3]
    assert {r.n_words for r in rows} == {0, 36}
    assert fm_index.remove_repeats(df.where("false")).count() == 0


def test_index_matches_foreign_text():
    """Windows of a text that the index does not hold, with breaks in the middle of a match."""
    rng = np.random.default_rng(5)
    window = 6
    text = np.concatenate([[0], rng.integers(1, 4, 300), [0], rng.integers(1, 4, 200), [0]])
    index = fm_index.FMIndex(text, 5, window)
    other = rng.integers(1, 5, 400)
    seen = {}
    for i in range(len(text) - window + 1):
        seen.setdefault(tuple(text[i:i + window]), []).append(i)
    got = {}
    for who, at, row, rows in index.matches(other, np.array([0, 250]), np.array([200 - window + 1, 150 - window + 1])):
        for a, r, n in zip(at, row, rows):
            got[int(a)] = (int(index.rows[r]), int(n))
    starts = [*range(0, 200 - window + 1), *range(250, 400 - window + 1)]
    want = {i: (seen[t][0], len(seen[t])) for i in starts if (t := tuple(other[i:i + window])) in seen}
    assert got == want and want


def test_query_has_contract_columns(spark, sf_dir):
    df = queries.op11_substring_dedup(spark, sf_dir)
    assert df.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {k: (n, r, hashlib.sha256(t.encode()).hexdigest()) for k, (n, r, t) in plain([(d.doc_id, d.text) for d in docs]).items()}
    assert found(df) == want
