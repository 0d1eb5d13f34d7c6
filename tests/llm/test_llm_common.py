"""Ordered neighbours and connected components against plain Python."""

import random

from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.common import components, joined_components, with_next


def union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(1, 300)]
    noise = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    edges = [e for e in chain + star + noise if e[0] != e[1]]
    df = spark.createDataFrame(edges + [(7, 7), (9, None), (None, None)] + edges[:20], "u long, v long")
    assert {r.id: r.component for r in components(df).collect()} == union_find(edges)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_star_is_contracted_in_one_round(spark, monkeypatch):
    written, write = [], common.cut_lineage
    monkeypatch.setattr(common, "cut_lineage", lambda df, name: written.append(name) or write(df, name))
    edges = [(500, 500 + i) for i in range(1, 300)] + [(i, 2000) for i in range(1000, 1300)]
    assert {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == union_find(edges)
    assert written.count("edges") == 2  # the edges given and what one round leaves


def test_added_edges_join_known_components(spark):
    rng = random.Random(8)
    old = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)]
    new = [(rng.randrange(400), rng.randrange(400)) for _ in range(40)]
    old, new = ([e for e in x if e[0] != e[1]] for x in (old, new))
    classes = components(spark.createDataFrame(old, "u long, v long"))
    for more in (new, old[:5], []):
        found = joined_components(classes, spark.createDataFrame(more + [(3, 3), (None, 5)], "u long, v long"))
        assert sorted((r.id, r.component) for r in found.collect()) == sorted(union_find(old + more).items())


def test_next_row_wraps_over_ranges(spark):
    rng = random.Random(5)
    ids = rng.sample(range(-10 ** 12, 10 ** 12), 300) + [2 ** 62, 2 ** 62 + 1]
    rows = [(i, f"t{i}") for i in ids]
    got = with_next(spark.createDataFrame(rows, "k long, t string").repartition(5), "k", "t", {"t": "after"}, buckets=16)
    order = sorted(rows)
    assert {r.k: r.after for r in got.collect()} == {k: order[(n + 1) % len(order)][1] for n, (k, _) in enumerate(order)}


def test_next_row_ties_nulls_and_single(spark):
    df = spark.createDataFrame([(None, "n"), (1, "b"), (1, "a"), (2, "c")], "k long, t string")
    got = {r.t: r.after for r in with_next(df, "k", "t", {"t": "after"}, buckets=4).collect()}
    assert got == {"n": "a", "a": "b", "b": "c", "c": "n"}
    one = with_next(df.where("t = 'c'"), "k", "t", {"big": "after"}, {"big": F.upper("t")}).collect()
    assert [(r.t, r.after) for r in one] == [("c", "C")]
    assert with_next(df.where("false"), "k", "t", {"t": "after"}).count() == 0
