import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import dart_minhash as dm
from tidewatch.llm import hnsw, queries
from test_llm_common import union_find


def sets(a, b):
    ids = np.arange(1, 400, dtype=np.uint64)
    pick = lambda w: (ids[np.array(w) > 0], np.array(w)[np.array(w) > 0])
    return pick(a), pick(b)


def test_signatures_estimate_weighted_likeness():
    rng = np.random.default_rng(2)
    for shape in (1, 30, 1000):
        a = rng.integers(0, shape + 1, 399)
        b = np.where(rng.random(399) < 0.7, a, rng.integers(0, shape + 1, 399))
        x, y = sets(a, b)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        one, two = dm.dart_signatures([x, y], 4000)
        assert abs((one == two).mean() - true) < 0.04 and abs(dm.likeness(x, y) - true) < 1e-12


def test_signatures_do_not_depend_on_their_batch():
    s = dm.Shingles()
    found = [s(t) for t in ("one two three four five six", "a", "x y z " * 500, "one two three four five six")]
    every = dm.dart_signatures(found, 80)
    assert (every[0] == every[3]).all() and all((dm.dart_signatures([f], 80)[0] == e).all() for f, e in zip(found, every))


def brute_shingles(text):
    w = (text or "").lower().split()
    out = {}
    for i in range(max(1, len(w) - 4) if w else 0):
        out[tuple(w[i:i + 5])] = out.get(tuple(w[i:i + 5]), 0) + 1
    return out


def brute_links(docs, threshold=0.8):
    s = {i: brute_shingles(t) for i, t in docs.items()}
    edges = []
    for a, b in itertools.combinations(sorted(s), 2):
        x, y = s[a], s[b]
        na, nb = sum(x.values()), sum(y.values())
        if na and nb and min(na, nb) >= threshold * max(na, nb):
            low = sum(min(n, y.get(k, 0)) for k, n in x.items())
            if low >= threshold * (na + nb - low):
                edges.append((a, b))
    return edges


def test_shingles_count_like_plain_python():
    for text in ("", " \t", "one", "A b c", "a b c d e a b c d e a b", "ß Ü x y z 漢 字 q"):
        h, n = dm.Shingles()(text)
        assert sorted(n.tolist()) == sorted(brute_shingles(text).values())


def edited(rng, words, share):
    w = list(words)
    for i in rng.sample(range(len(w)), max(1, int(share * len(w)))):
        w[i] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(w)


def test_classes_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    docs = {}
    for g in range(12):
        base = [word() for _ in range(rng.choice([30, 120, 400]))]
        for k in range(rng.choice([1, 2, 6])):
            docs[len(docs)] = " ".join(base) if k == 1 else edited(rng, base, rng.choice([0.01, 0.03, 0.08]))
    hub = [word() for _ in range(150)]
    for _ in range(80):  # a large group whose members are often below the threshold to each other
        docs[len(docs)] = edited(rng, hub, 0.022)
    for t in ("", None, "a", "a", "A  a", "a b c d", "same few words", "same few words", "z " * 30_000, "z " * 29_000):
        docs[len(docs)] = t
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()] + [(None, "a", "x", 1), (None, None, "x", 1), (0, docs[0], "x", 1)],
                               "doc_id long, text string, component string, size int")
    want = union_find(brute_links(docs))
    got = {r.id: r.component for r in dm.near_duplicates(df).collect()}
    assert {i: got[i] for i in got} == {i: want.get(i, i) for i, t in docs.items() if brute_shingles(t)}
    kept = dm.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in docs if want.get(i, i) == i) and ids.count(None) == 2
    assert dm.near_duplicates(df.where("false")).count() == 0


def test_document_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = union_find(brute_links(docs))
    rows = queries.op6_minhash_dedup(spark, sf_dir).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: want.get(i, i) for i in docs}
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def brute_vectors(rows, threshold=0.93):
    ok = {}
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (label, np.array(v, float))
    edges, n = [], {i: 0 for i, *_ in rows}
    for a, b in itertools.combinations(sorted(ok), 2):
        (la, x), (lb, y) = ok[a], ok[b]
        if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
            edges.append((a, b))
            n[a] += 1
            n[b] += 1
    return edges, n


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(60):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows) * 3, (base + rng.normal(size=16) * rng.choice([0.01, 0.2, 0.27])).astype("f4").tolist(), int(c % 3)))
    hub = rng.normal(size=16)
    for _ in range(300):
        rows.append((len(rows) * 3, (hub + rng.normal(size=16) * 0.15).astype("f4").tolist(), 1))
    one = rows[0][1]
    rows += [(5000 + k, v, label) for k, (v, label) in enumerate([
        (None, 1), ([], 1), ([0.0] * 16, 1), ([None] + one[1:], 0), ([float("nan")] + one[1:], 0), ([float("inf")] + one[1:], 0),
        (one, None), (one, 0), ([x * 1e-30 for x in one], 0), (one[:8], 0), (one[:8], 0), ([1e-3] * 16, 77)])]
    df = spark.createDataFrame([(*r, True) for r in rows] + [(None, one, 0, True), (0, one, 0, False)],
                               "vec_id long, embedding array<float>, label int, kept boolean")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    edges, n = brute_vectors(rows)
    want = union_find(edges)
    for size in (100, 8192):  # several shards a label, and one
        got = {r.vec_id: r for r in hnsw.near_duplicates(df, shard_rows=size, audit_share=0.5).collect()}
        assert {i: got[i].component_id for i in n} == {i: want.get(i, i) for i in n}
        assert sum(got[i].n_links != k for i, k in n.items()) <= 2
        assert got[None].kept and got[None].n_links == 0 and len(got) == len(n) + 1
    assert hnsw.near_duplicates(df.where("false")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(5)
    x = hnsw._unit_rows(np.concatenate([rng.normal(size=(1500, 32)), rng.normal(size=32) + 0.1 * rng.normal(size=(500, 32))])).astype("f4")
    layers = hnsw.build(x, hnsw._seeds(np.arange(len(x))))
    r, c, widths = hnsw.search_links(x, layers, x, 0.93, np.arange(0, len(x), 10))
    found = set(zip(r.tolist(), c.tolist()))
    true = set(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.93))))
    assert len(found & true) >= 0.999 * len(true) and widths == sorted(widths)


def test_a_large_group_needs_no_wider_beam():
    rng = np.random.default_rng(6)
    group = rng.normal(size=32) + 0.02 * rng.normal(size=(700, 32))  # every member links with 699 others, a beam holds 64
    x = hnsw._unit_rows(np.concatenate([rng.normal(size=(900, 32)), group])).astype("f4")
    layers = hnsw.build(x, hnsw._seeds(np.arange(len(x))))
    assert np.isin(np.arange(len(x)), layers[-1][1]).all()  # every node can be reached from another
    true = set(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.93))))
    for options in ({}, {"own": True}):
        r, c, widths = hnsw.search_links(x, layers, x, 0.93, np.arange(0, len(x), 10), **options)
        assert widths == [64] and len(true - set(zip(r.tolist(), c.tolist()))) <= (0 if options else 0.001 * len(true))


def test_repeated_rows_in_a_large_unsettled_bucket(spark):
    rows, number = [], itertools.count()
    passage = [f"c{i}" for i in range(89)]  # every text shares 85 shingles with every other: buckets of about a hundred

    def text(shared):  # 100 shingles
        return " ".join(passage + shared + [f"o{next(number)}" for _ in range(15 - len(shared))])

    for _ in range(300):
        rows.append((len(rows), text([])))
    for g in range(12):  # pairs of likeness 90 / 110, the first of each with its row repeated
        shared = [f"s{g}-{i}" for i in range(5)]
        rows += [(len(rows), text(shared)), (len(rows) + 1, text(shared))]
    docs = dict(rows)
    assert brute_links({i: docs[i] for i in range(298, 304)}) == [(300, 301), (302, 303)]
    rows += rows[300::2]
    got = {r.id: r for r in dm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.component for i, r in got.items()} == {i: i - (i > 300 and i % 2) for i in docs}
    assert {i: r.links for i, r in got.items()} == {i: int(i >= 300) for i in docs}


def test_first_rounds_are_verified_together_and_empty_steps_left_out(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    docs = {i: " ".join(words[:59] + [f"end{i}"]) for i in range(40)} | {100 + i: f"other text {i} alone here {i}" for i in range(20)}
    written, write = [], dm.cut_lineage
    monkeypatch.setattr(dm, "cut_lineage", lambda df, name: written.append(name) or write(df, name))
    rows = dm.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    want = union_find(brute_links(docs))
    assert {r.id: r.component for r in rows} == {i: want.get(i, i) for i in docs}
    assert written.count("links") <= 3 and "shingles" not in written  # three checks of pairs, nothing left for the exact join
