"""Tree ensembles against a plain recursive version, bootstrap draws, store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import forest, learn
from tidewatch.sources import store, tables


def plain_tree(x, y, w, spec, tree):
    """The same trees node by node with a queue; no array of nodes is shared with the grower."""
    feats = list(range(x.shape[1])) if spec.slots is None else list(spec.slots)
    tried = max(1, int(len(feats) ** 0.5))
    nodes, queue = [None], [(0, np.arange(len(y)), 0)]
    while queue:
        i, at, depth = queue.pop(0)
        share = (w[at] * y[at]).sum() / w[at].sum()
        nodes[i] = (-1, 0.0, -1, share)
        if depth >= spec.max_depth or len(at) < 2 * spec.min_leaf or len(set(y[at])) < 2:
            continue
        varying = [f for f in feats if x[at, f].max() > x[at, f].min()]
        varying.sort(key=lambda f: (float(forest.draw(spec.seed, tree, i, f, 0)), f))
        best = None
        for f in varying[:tried]:
            v = x[at, f]
            if spec.kind == "extra_trees":
                cut = v.min() + float(forest.draw(spec.seed, tree, i, f, 1)) * (v.max() - v.min())
                cuts = [cut if cut < v.max() else v.min()]
            else:
                values = np.unique(v)
                cuts = [a / 2 + b / 2 if a / 2 + b / 2 < b else a for a, b in zip(values, values[1:])]
            for cut in cuts:
                left = v <= cut
                if min(left.sum(), (~left).sum()) < spec.min_leaf:
                    continue
                score = 0.0
                for side in (left, ~left):
                    a, p = w[at][side].sum(), (w[at] * y[at])[side].sum()
                    score += (p * p + (a - p) * (a - p)) / a
                if best is None or score > best[0] + 1e-9:
                    best = (score, f, cut, left)
        if best is None:
            continue
        _, f, cut, left = best
        nodes[i] = (f, cut, len(nodes), share)
        nodes += [None, None]
        queue += [(len(nodes) - 2, at[left], depth + 1), (len(nodes) - 1, at[~left], depth + 1)]
    return nodes


def sample(n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=(n, 4)), rng.integers(0, 4, (n, 2)), np.zeros(n), rng.integers(0, 2, (n, 3))]).astype(float)
    y = (x[:, 0] + x[:, 1] * x[:, 4] + rng.normal(size=n) * 0.4 > 0.5).astype(int)
    return x, y


def plain_auc(y, s):
    p, n = s[y == 1], s[y == 0]
    return float(((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n)))


@pytest.mark.parametrize("kind", ["random_forest", "extra_trees"])
@pytest.mark.parametrize("slots,depth", [(None, 30), ((0, 1, 4, 7), 5)])
def test_grown_tree_is_the_plain_tree(kind, slots, depth):
    x, y = sample()
    spec = forest.Ensemble("m", kind, slots=slots, max_depth=depth)
    w = np.random.default_rng(3).integers(1, 4, len(y)).astype(float)
    for tree in range(6):
        got, want = forest.grow_tree(x, y, w, spec, tree), plain_tree(x, y, w, spec, tree)
        assert got["feature"].tolist() == [n[0] for n in want]
        assert got["left"].tolist() == [n[2] for n in want]
        np.testing.assert_allclose(got["threshold"], [n[1] for n in want])
        np.testing.assert_allclose(got["value"], [n[3] for n in want])


def _rows(spark, x, y):
    return spark.createDataFrame([(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, label int, features array<double>")


@pytest.mark.parametrize("kind", ["random_forest", "extra_trees"])
def test_ensemble_in_spark_is_the_plain_ensemble(spark, kind):
    x, y = sample()
    spec = forest.Ensemble("m", kind, trees=20)
    rows = _rows(spark, x, y)
    nodes = forest.grow(rows.repartition(5), [spec]).cache()
    counts = {(r.tree, r.id): r.times for r in forest.bootstrap_counts(rows.select("id"), 20, spec.seed).collect()}
    plain = np.zeros(len(y))
    for t in range(20):
        times = np.array([counts[t, i] if kind == "random_forest" else 1 for i in range(len(y))])
        drawn = [times[y == c].sum() for c in (0, 1)]
        w = times * np.array([times.sum() / (2 * drawn[c]) for c in y])
        at = np.flatnonzero(times)
        tree = plain_tree(x[at], y[at], w[at], spec, t)
        for i in range(len(y)):
            k = 0
            while tree[k][2] >= 0:
                k = tree[k][2] + int(x[i, tree[k][0]] > tree[k][1])
            plain[i] += tree[k][3] / 20
    got = {r.id: r.score for r in forest.score_rows(rows, forest.Trees(nodes)).collect()}
    scores = np.array([got[i] for i in range(len(y))])
    assert np.abs(scores - plain).max() < 1e-9
    assert abs(plain_auc(y, scores) - plain_auc(y, plain)) < 1e-9 and plain_auc(y, scores) > 0.95
    imp = forest.importances(nodes, x.shape[1])
    assert abs(sum(imp) - 1) < 1e-9 and imp[6] == 0 and max(imp) in imp[:2]


def test_held_out_rows_are_told_apart(spark):
    x, y = sample(900, 5)
    nodes = forest.grow(_rows(spark, x[:600], y[:600]), [forest.Ensemble(k, k, trees=60) for k in learn.TREE_KINDS]).cache()
    for kind in learn.TREE_KINDS:
        assert plain_auc(y[600:], forest.Trees(nodes.where(F.col("model") == kind)).score(x[600:])) > 0.85


def test_poisson_counts_have_mean_and_variance_one(spark):
    t = forest.bootstrap_counts(spark.range(2000), 20, 7).agg(F.avg("times").alias("m"), F.var_pop("times").alias("v")).first()
    assert abs(t.m - 1) < 0.03 and abs(t.v - 1) < 0.05


def test_one_class_gives_leaves(spark):
    x, _ = sample(30)
    nodes = forest.grow(_rows(spark, x, np.ones(30)), [forest.Ensemble("m", trees=3)])
    assert [(r.left, r.value) for r in nodes.collect()] == [(-1, 1.0)] * 3


def test_model_is_saved_read_back_and_reused(spark, tmp_path):
    x, y = sample(200)
    df = spark.createDataFrame([(i, int(b), float(a[0]), float(a[1]), "ab"[int(a[4]) % 2]) for i, (a, b) in enumerate(zip(x, y))],
                               "reading_id long, label int, precipitation double, humidity double, district string")
    feats = learn.Features(["precipitation", "humidity"], ["district"])
    spec = learn.ModelSpec("extra_trees", trees=8, fit_rows=150)
    built = []
    df.write.parquet(str(tmp_path / "in"))

    def build():
        built.append(1)
        return learn.fit(df, feats, spec)

    a, b = (store.model_once(spark, "t", [str(tmp_path / "in")], spec, build) for _ in range(2))
    assert len(built) == 1 and a.spec == b.spec == spec
    tables.save_model(a, str(tmp_path / "m"))
    c = tables.load_model(spark, str(tmp_path / "m"))
    scores = [{r.reading_id: (r.score, r.prediction) for r in learn.predict(m, df).collect()} for m in (a, c)]
    assert scores[0] == scores[1] and len(scores[0]) == 200
    assert {r.feature for r in learn.feature_importance(c).collect()} == {"num__precipitation", "num__humidity", "cat__district_a", "cat__district_b"}


def test_store_publishes_whole_tables_once(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    seen = []

    def build(n):
        seen.append(n)
        return spark.range(n)

    assert store.once(spark, "publish", [str(tmp_path / "in")], lambda: build(5)).count() == 5
    assert store.once(spark, "publish", [str(tmp_path / "in")], lambda: build(9)).count() == 5 and seen == [5]

    def late():  # another writer is done first
        path = store._place(spark, "race", [str(tmp_path / "in")])
        spark.range(2).write.parquet(path)
        return spark.range(7)

    assert store.once(spark, "race", [str(tmp_path / "in")], late).count() == 2


def plain_tops(x, y, w, spec, tree, limit):
    """Nodes of more than ``limit`` rows cut with a queue, the others grown by ``plain_tree`` with their root's number."""
    feats = list(range(x.shape[1]))
    nodes, parts, queue = [None], [], [(0, np.arange(len(y)), 0)]
    while queue:
        i, at, depth = queue.pop(0)
        if len(at) <= limit or len(set(y[at])) < 2:
            own = forest.Ensemble("m", spec.kind, max_depth=spec.max_depth - depth)
            parts.append((i, plain_tree(x[at], y[at], w[at], own, tree + (i << 32))))
            continue
        stump = forest.Ensemble("m", spec.kind, max_depth=1)
        varying = sorted((f for f in feats if x[at, f].max() > x[at, f].min()), key=lambda f: (float(forest.draw(spec.seed, tree, i, f, 0)), f))
        tried = varying[:max(1, int(len(feats) ** 0.5))]
        best = None
        for f in tried:
            v = x[at, f]
            if spec.kind == "extra_trees":
                cut = v.min() + float(forest.draw(spec.seed, tree, i, f, 1)) * (v.max() - v.min())
                cuts = [cut if cut < v.max() else v.min()]
            else:
                values = np.unique(v)
                cuts = [a / 2 + b / 2 for a, b in zip(values, values[1:])]
            for cut in cuts:
                left = v <= cut
                if min(left.sum(), (~left).sum()) >= stump.min_leaf:
                    sides = [(w[at][s].sum(), (w[at] * y[at])[s].sum()) for s in (left, ~left)]
                    score = sum((p * p + (a - p) * (a - p)) / a for a, p in sides)
                    if best is None or score > best[0] + 1e-9:
                        best = (score, f, cut, left)
        _, f, cut, left = best
        nodes[i] = (f, cut, len(nodes), (w[at] * y[at]).sum() / w[at].sum())
        nodes += [None, None]
        queue += [(len(nodes) - 2, at[left], depth + 1), (len(nodes) - 1, at[~left], depth + 1)]
    for i, part in parts:
        after = len(nodes) - 1
        moved = [(f, cut, left + after if left >= 0 else -1, v) for f, cut, left, v in part]
        nodes[i] = moved[0]
        nodes += moved[1:]
    return nodes


@pytest.mark.parametrize("kind,blocks", [("random_forest", 4), ("random_forest", 64), ("extra_trees", 64)])
def test_trees_of_more_rows_than_a_task_holds_are_the_plain_trees(spark, kind, blocks):
    x, y = sample(500, 9)
    x[:, 0] = np.round(x[:, 0], 1)
    spec = forest.Ensemble("m", kind, trees=3)
    rows = _rows(spark, x, y)
    nodes = forest.grow(rows.repartition(3), [spec], cells=100 * x.shape[1], blocks=blocks)
    counts = {(r.tree, r.id): r.times for r in forest.bootstrap_counts(rows.select("id"), 3, spec.seed).collect()}
    got = {t: {} for t in range(3)}
    for r in nodes.collect():
        assert r.node not in got[r.tree]
        got[r.tree][r.node] = r
    for t in range(3):
        times = np.array([counts[t, i] if kind == "random_forest" else 1 for i in range(len(y))])
        w = times * np.array([times.sum() / (2 * times[y == c].sum()) for c in y])
        at = np.flatnonzero(times)
        want = plain_tops(x[at], y[at], w[at], spec, t, 100)
        assert sorted(got[t]) == list(range(len(got[t]))) and len(got[t]) == len(want)

        def walk(i, j):  # parts stand in another order
            a, b = got[t][i], want[j]
            assert (a.feature, a.left < 0) == (b[0], b[2] < 0) and abs(a.threshold - b[1]) < 1e-9 and abs(a.value - b[3]) < 1e-9
            if a.left >= 0:
                walk(a.left, b[2])
                walk(a.left + 1, b[2] + 1)

        walk(0, 0)
    assert nodes.where("feature >= 0 and gain < -1e-9").count() == 0


def test_trees_score_in_parts(spark):
    x, y = sample(400)
    rows = _rows(spark, x, y)
    nodes = forest.grow(rows, [forest.Ensemble("m", trees=9)])
    one, many = forest.Trees(nodes), forest.Trees(nodes, 150)
    assert len(one.ranges) == 1 and len(many.ranges) > 3
    np.testing.assert_allclose(many.score(x), one.score(x))
    a, b = ({r.id: r.score for r in forest.score_rows(rows.repartition(3), t).collect()} for t in (one, many))
    assert len(a) == 400 and max(abs(a[i] - b[i]) for i in a) < 1e-12


def test_trees_grow_on_all_labelled_rows(spark):
    """The root of an unweighted extremely randomised tree holds the label's rate over all rows, however many."""
    df = spark.range(5000).select(F.col("id").alias("reading_id"), F.when(F.col("id") < 4900, (F.col("id") % 7 == 0).cast("int")).alias("label"),
                                  (F.col("id") % 13).cast("double").alias("precipitation"), F.lit("a").alias("district"))
    feats = learn.Features(["precipitation"], ["district"])
    model = learn.fit(df, feats, learn.ModelSpec("extra_trees", trees=2, balanced=False))
    assert {r.value for r in model.nodes.where("node = 0").collect()} == {700 / 4900}
