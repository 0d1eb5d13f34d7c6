"""Embedding near-duplicates by hierarchical navigable small-world graphs per shard.

Vectors of one label are dealt into shards by a hash of their ids.  Every shard
gets a layered graph; every vector queries every shard of its label with a beam
search, which goes on over every node in the link range.  A sample of the
queries is answered by a full scan as well: while the beams miss one of its
links, they are widened, at last to the whole shard.  Found links are verified by
cosine in double precision, counted, and united.

Defined cases: null labels, and vectors that are null, empty, zero or hold null
or non-finite parts, link with nothing; vectors of different lengths do not
link; rows repeating an id are one vector (within a label the bytewise smallest
embedding counts); null ids link with nothing and are kept with a null class;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

from .common import components, ship

ship(__name__)


def beam_search(x, graph, queries, entry, width: int, expand: int = 4, hits: float | None = None, rim: float = 0.02):
    """Best ``width`` nodes per query on one layer, and every node seen at ``hits`` or above.

    ``graph`` is (nodes, neighbours) with -1 for none; ``entry`` is (queries,
    starts).  All queries step together, each expanding its best open nodes
    (``expand`` of them, or an eighth of the beam).
    Returns (ids, similarities, worst similarity kept, hit query rows, hit ids).
    """
    q = len(queries)
    seen = np.zeros((q, len(x)), bool)
    ids = np.full((q, width), -1, np.int32)
    sims = np.full((q, width), -np.inf, np.float32)
    open_ = np.zeros((q, width), bool)
    hit_q, hit_x = [], []

    def add(rows, cand):
        """Offer candidates (rows x c, -1 for none) to the beams of rows."""
        cand = np.sort(cand, axis=1)
        fresh = cand >= 0
        fresh[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        fresh &= ~seen[rows[:, None], cand]
        r, c = np.nonzero(fresh)
        new = cand[r, c]
        seen[rows[r], new] = True
        s = np.full(cand.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("ij,ij->i", queries[rows[r]], x[new])
        if hits is not None:
            near = s[r, c] >= hits
            hit_q.append(rows[r][near])
            hit_x.append(new[near])
        all_s = np.concatenate([sims[rows], s], axis=1)
        all_i = np.concatenate([ids[rows], np.where(fresh, cand, -1)], axis=1)
        all_o = np.concatenate([open_[rows], fresh], axis=1)
        top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
        at = np.arange(len(rows))[:, None]
        sims[rows], ids[rows], open_[rows] = all_s[at, top], all_i[at, top], all_o[at, top]

    add(np.arange(q), entry.astype(np.int32))
    while True:
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            break
        step = min(max(expand, width // 8), width)
        score = np.where(open_[rows], sims[rows], -np.inf)
        best = np.argpartition(-score, step - 1, axis=1)[:, :step]
        at = np.arange(len(rows))[:, None]
        use = np.isfinite(score[at, best])
        nodes = np.where(use, ids[rows][at, best], 0)
        near = np.where(use[:, :, None], graph[nodes], -1).reshape(len(rows), -1)
        mask = open_[rows]
        mask[at, best] = False
        open_[rows] = mask
        add(rows, near)
    worst = sims.min(axis=1)
    if hits is None:
        return ids, sims, worst, None, None
    hit_q, hit_x = np.concatenate(hit_q), np.concatenate(hit_x)
    pushed_out = worst[hit_q] >= hits - rim  # the beam was too narrow for the range: go on from all of these rows' hits
    more_q, more_x = _spread(x, graph, queries, hit_q[pushed_out], hit_x[pushed_out], seen, hits, rim)
    return ids, sims, worst, np.concatenate([hit_q, more_q]), np.concatenate([hit_x, more_x])


def _spread(x, graph, queries, rows, nodes, seen, hits: float, rim: float, most: int = 50_000):
    """Nodes at ``hits`` or above, beyond those seen, reached from (query row, node) pairs over nodes at most ``rim`` below it."""
    reached = seen.reshape(-1)
    stack, out_q, out_x = [(rows, nodes)], [], []
    while stack:
        r, c = stack.pop()
        if len(r) > most:
            stack.append((r[most:], c[most:]))
            r, c = r[:most], c[:most]
        near = graph[c]
        flat = (r[:, None].astype(np.int64) * len(x) + near)[near >= 0]
        flat = np.unique(flat[~reached[flat]])
        reached[flat] = True
        r, c = np.divmod(flat, len(x))
        sims = np.einsum("ij,ij->i", queries[r], x[c])
        out_q.append(r[sims >= hits])
        out_x.append(c[sims >= hits])
        if (sims >= hits - rim).any():
            stack.append((r[sims >= hits - rim], c[sims >= hits - rim]))
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_q) if out_q else none), (np.concatenate(out_x) if out_x else none)


def _diverse(x, nodes, cand, sim, m: int):
    """Per node (row) up to m of its candidates, -1 behind them: nearest first, skipping those nearer to one chosen than to the node.

    ``cand`` and ``sim`` are (nodes, candidates), -1 for none; repeats count once.
    """
    order = np.argsort(cand, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    good = (cand >= 0) & (cand != nodes[:, None]) & np.isfinite(sim)
    good[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    sim = np.where(good, sim, -np.inf)
    order = np.argsort(-sim, axis=1, kind="stable")[:, :max(1, min(4 * m, int(good.sum(axis=1).max(initial=1))))]
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    good = np.isfinite(sim)
    near = x[np.where(good, cand, 0)]
    among = near @ near.transpose(0, 2, 1)
    chosen, crowd, left = np.zeros(cand.shape, bool), np.full(cand.shape, -np.inf, np.float32), np.full(len(cand), m)
    for i in range(cand.shape[1]):
        take = good[:, i] & (crowd[:, i] < sim[:, i]) & (left > 0)
        chosen[:, i] = take
        left -= take
        crowd[take] = np.maximum(crowd[take], among[take, i])
    spare = good & ~chosen
    few = good.sum(axis=1) <= m // 2
    fill = np.where(few, m, m // 2 - chosen.sum(axis=1))
    chosen |= spare & (np.cumsum(spare, axis=1) <= fill[:, None])
    order = np.argsort(~chosen, axis=1, kind="stable")[:, :m]
    out = np.full((len(cand), m), -1, np.int32)
    out[:, :order.shape[1]] = np.where(np.take_along_axis(chosen, order, 1), np.take_along_axis(cand, order, 1), -1)
    return out


def _link_back(x, graph, nodes, links, cap: int, rows: int = 256):
    """Every node becomes a neighbour of those it links to; lists longer than ``cap`` are pruned."""
    r, c = np.nonzero(links >= 0)
    other, news = links[r, c], nodes[r]
    order = np.argsort(other, kind="stable")
    other, news = other[order], news[order]
    touched, first, count = np.unique(other, return_index=True, return_counts=True)
    by_count = np.argsort(count, kind="stable")  # lists of like length side by side
    for a in range(0, len(touched), rows):
        at = by_count[a:a + rows]
        k = np.arange(count[at].max())
        add = np.where(k < count[at][:, None], news[np.minimum(first[at][:, None] + k, len(news) - 1)], -1)
        both = -np.sort(-np.concatenate([graph[touched[at]], add.astype(np.int32)], axis=1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        both = -np.sort(-both, axis=1)
        long = (both >= 0).sum(axis=1) > cap
        if long.any():
            sim = np.full(both[long].shape, -np.inf, np.float32)
            i, j = np.nonzero(both[long] >= 0)
            sim[i, j] = np.einsum("ij,ij->i", x[both[long][i, j]], x[touched[at][long][i]])
            graph[touched[at][long]] = _diverse(x, touched[at][long], both[long], sim, cap)
        short = both[~long][:, :cap]
        graph[touched[at][~long], :short.shape[1]] = short


def _adopt(x, graph, nodes):
    """A node that no list holds enters that of its nearest neighbour with room (else of the nearest, for the last there)."""
    for node in np.setdiff1d(nodes, graph):
        own = graph[node][graph[node] >= 0]
        if len(own):
            own = own[np.argsort(-(x[own] @ x[node]), kind="stable")]
            room = (graph[own] < 0).any(axis=1)
            to = own[room.argmax()] if room.any() else own[0]
            free = graph[to] < 0
            graph[to, free.argmax() if free.any() else -1] = node


def build(x, seeds, m: int = 12, width: int = 48, block: int = 256):
    """Layers of a graph over unit vectors, top first: [(node numbers, neighbours of all nodes)].

    A node's top layer falls off exponentially by its seed.  Layers are filled
    from the top; a block of nodes searches what is there, sees its own block
    too, and links both ways, pruned to the most diverse neighbours.
    """
    n = len(x)
    level = np.floor(-np.log(np.maximum(seeds, 1e-12)) / np.log(m)).astype(int)
    level = np.minimum(level, max(0, int(np.log(max(n, 2)) / np.log(m))))
    layers: list = []
    for lev in range(level.max() if n else 0, -1, -1):
        nodes = np.flatnonzero(level >= lev)
        cap = 2 * m if lev == 0 else m
        graph = np.full((n, cap), -1, np.int32)
        above = layers[-1][0] if layers else nodes[:0]
        done = 0
        order = np.concatenate([above, np.setdiff1d(nodes, above)])
        while done < len(order):
            now = order[done:done + block]
            inner = (x[now] @ x[now].T).astype(np.float32)
            np.fill_diagonal(inner, -np.inf)
            cand, sim = np.broadcast_to(now.astype(np.int32), inner.shape), inner
            if done:
                entry = starts(x, layers, x[now], m) if layers else np.broadcast_to(order[:1], (len(now), 1))
                entry = np.where(np.isin(entry, order[:done]), entry, order[0])
                ids, s, *_ = beam_search(x, graph, x[now], entry, min(width, max(done, 1)))
                cand, sim = np.concatenate([cand, ids], axis=1), np.concatenate([sim, s], axis=1)
            links = _diverse(x, now, cand, sim, m)
            graph[now, :m] = links
            _link_back(x, graph, now, links, cap)
            done += len(now)
        _adopt(x, graph, nodes)
        layers.append((order, graph))
    return layers


def starts(x, layers, queries, count: int):
    """Entry nodes for the next layer down: the best of a narrow descent through the layers given."""
    entry = np.broadcast_to(layers[0][0][:1], (len(queries), 1))
    for _, graph in layers:
        ids, _, *_ = beam_search(x, graph, queries, entry, count)
        entry = ids
    return entry


def search_links(x, layers, queries, threshold: float, audit, width: int = 64, m: int = 12, block: int = 512, own: bool = False):
    """All (query, node) pairs at ``threshold`` or above (single precision with a margin).

    A beam that the link range fills goes on over all nodes in range, so its cost
    follows the links and not its width.  ``own``: the queries are the nodes; each
    starts at itself, and a link found one way holds both ways.  ``audit``: numbers
    of the queries also answered by a full scan; while one of them misses a link,
    all beams are widened.
    Returns (query rows, nodes, widths used).
    """
    margin = threshold - 1e-4
    truth, used = [np.zeros(0, np.int64)], []
    for a in range(0, len(audit), block):  # well inside the margin, so that rounding decides nothing
        at, node = np.nonzero(queries[audit[a:a + block]] @ x.T >= threshold - 1e-5)
        truth.append(audit[a + at].astype(np.int64) * len(x) + node)
    truth = np.concatenate(truth)
    while True:
        used.append(width)
        found_q, found_x = [], []
        for a in range(0, len(queries), block):
            rows = np.arange(a, min(a + block, len(queries)))
            if width >= len(x):  # the beam holds the whole shard
                hq, hx = np.nonzero(queries[rows] @ x.T >= margin)
            else:
                if own:
                    entry = rows[:, None]
                elif len(layers) > 1:
                    entry = starts(x, layers[:-1], queries[rows], m)
                else:
                    entry = np.broadcast_to(layers[0][0][:1], (len(rows), 1))
                *_, hq, hx = beam_search(x, layers[-1][1], queries[rows], entry, width, hits=margin)
            found_q.append(rows[hq])
            found_x.append(hx)
        rows = np.concatenate(found_q) if found_q else np.zeros(0, np.int64)
        nodes = np.concatenate(found_x).astype(np.int64) if found_x else rows
        if own:
            rows, nodes = np.divmod(np.unique(np.concatenate([rows * len(x) + nodes, nodes * len(x) + rows])), len(x))
        if width >= len(x) or np.isin(truth, rows * len(x) + nodes).all():
            return rows, nodes, used
        width = min(4 * width, len(x))


def _roots(n: int, a, b):
    """Smallest reachable number of every node of 0 .. n - 1 over links a - b."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == old).all():
            return root


def links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
          threshold: float = 0.93, shard_rows: int = 8192, audit_share: float = 0.1) -> DataFrame:
    """(id, n_links, root): per vector and shard asked, its links there, and a member of its class.

    Shards of a label are as many as its rows fill at ``shard_rows``; a graph is
    built in one task and written to the checkpoint folder, and each task then
    joins one shard's graph with one block (the members of one shard) of queries.
    What a task returns grows with the vectors, not with the links.
    """
    finite = F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec_col, lambda v: v != 0)
    v = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), F.struct(F.col(label_col).alias("l"), F.size(vec_col).alias("d")).alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec"))
    shards = v.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    v = v.join(shards, "label").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    v = v.select(F.xxhash64("label").alias("part"), "label", "shards", "shard", "id", "vec")

    def grow(rows):
        import pyarrow as pa

        ids, vecs = _distinct(rows)
        x = _unit_rows(vecs)
        layers = build(x.astype(np.float32), _seeds(ids))
        pack = [np.asarray(a, np.int32) for layer in layers for a in layer]
        head = rows.slice(0, 1).select(["label", "shards", "shard"])
        blobs = {"ids": ids.astype("<i8").tobytes(), "vecs": vecs.astype("<f8").tobytes(), "graph": b"".join(a.tobytes() for a in pack)}
        for name, blob in blobs.items():
            head = head.append_column(name, pa.array([blob], pa.binary()))
        return head.append_column("sizes", pa.array([[len(layer[0]) for layer in layers]], pa.list_(pa.int32())))

    kind = v.schema["label"].dataType.simpleString()
    index = cut_lineage(v.groupBy("part", "shard").applyInArrow(
        grow, f"label {kind}, shards int, shard int, ids binary, vecs binary, graph binary, sizes array<int>"), "hnsw")
    spread = lambda d: d.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    asked = spread(index.drop("shards", "graph", "sizes").join(shards, "label")) \
        .select(F.col("label").alias("q_label"), F.col("block").alias("q_shard"), F.col("shard").alias("q_block"),
                F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    graphs = spread(index)

    def ask(left, right):
        import pyarrow as pa

        out = pa.schema([("id", pa.int64()), ("n_links", pa.int64()), ("root", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        get = lambda t, c: t.column(c)[0].as_py()
        ids, vecs = np.frombuffer(get(left, "ids"), "<i8"), np.frombuffer(get(left, "vecs"), "<f8")
        x = _unit_rows(vecs.reshape(len(ids), -1))
        sizes, flat, layers, at = get(left, "sizes"), np.frombuffer(get(left, "graph"), np.int32), [], 0
        for place, size in enumerate(sizes):
            cap = 24 if place == len(sizes) - 1 else 12
            nodes = flat[at:at + size]
            layers.append((nodes, flat[at + size:at + size + len(ids) * cap].reshape(len(ids), cap)))
            at += size + len(ids) * cap
        q_ids, q_vecs = np.frombuffer(get(right, "q_ids"), "<i8"), np.frombuffer(get(right, "q_vecs"), "<f8")
        q = _unit_rows(q_vecs.reshape(len(q_ids), -1))
        audit = np.flatnonzero(_seeds(q_ids + 1) < audit_share) if len(q_ids) > 64 else np.arange(len(q_ids))
        own = len(q_ids) == len(ids) and (q_ids == ids).all()
        r, c, _ = search_links(x.astype(np.float32), layers, q.astype(np.float32), threshold, audit, own=own)
        true = np.concatenate([np.einsum("ij,ij->i", q[r[a:a + 100_000]], x[c[a:a + 100_000]]) >= threshold
                               for a in range(0, len(r), 100_000)]) if len(r) else np.zeros(0, bool)
        r, c = r[true], c[true]
        apart = q_ids[r] != ids[c]
        r, c = r[apart], c[apart]
        nodes, place = np.unique(np.concatenate([q_ids[r], ids[c]]), return_inverse=True)
        root = nodes[_roots(len(nodes), place[:len(r)], place[len(r):])] if len(nodes) else nodes
        asking = np.isin(nodes, q_ids)
        n = np.bincount(place[:len(r)], minlength=len(nodes)) if len(nodes) else np.zeros(0, int)
        return pa.table([pa.array(nodes, pa.int64()), pa.array(np.where(asking, n, 0), pa.int64()), pa.array(root, pa.int64())], schema=out)

    return graphs.groupBy("label", "shard", "block").cogroup(asked.groupBy("q_label", "q_shard", "q_block")) \
        .applyInArrow(ask, "id long, n_links long, root long")


def _distinct(rows):
    """(ids ascending, vectors) of a table's rows, one per id."""
    ids = rows.column("id").to_numpy()
    vecs = rows.column("vec").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    order = np.lexsort((*vecs.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    ids, vecs = ids[order], vecs[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    return ids[first], vecs[first]


def _unit_rows(vecs):
    scaled = vecs / np.abs(vecs).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _seeds(ids):
    """Hash of ids to (0, 1)."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0 ** -52


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """(id, n_links, component_id, kept), one row per vector id."""
    found = cut_lineage(links(vectors, id_col, **options), "vector-links")
    classes = components(found, "id", "root").select(F.col("id").alias("_c"), "component")
    counts = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    ids = vectors.select(F.col(id_col).cast("long").alias("_id")).distinct()
    out = ids.join(counts, ids["_id"] == counts["id"], "left").join(classes, F.col("_id") == F.col("_c"), "left")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component", "_id").alias("component_id"),
        F.coalesce(F.col("_id") == F.coalesce("component", "_id"), F.lit(True)).alias("kept"))
