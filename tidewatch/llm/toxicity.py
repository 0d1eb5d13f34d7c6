"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed character n-grams (3 to 5 code points,
lower-cased) it holds; a present feature has the value of its log-count ratio
between toxic and other training texts.  A linear support vector machine is
fitted on these by dual coordinate descent, and a two-parameter logistic curve
on texts left out of that fit turns margins into probabilities.

The fit uses a bounded sample: at most ``per_class`` labelled texts of each
class, the first by a hash of their ids.  Scoring reads every whole text.

Defined cases: null text is empty; an empty text has the score of the bare
intercept; labels other than 0 and 1 are ignored, and an id labelled both ways
counts as toxic; without texts of both classes every score is the share of
toxic labels (0 without labels); repeated rows are scored as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

BITS = 18
ORDERS = (3, 4, 5)


class Grams:
    """Distinct feature numbers of a text; the work table is reused between texts."""

    def __init__(self):
        import numpy as np

        self.np = np
        self.last = np.zeros(1 << BITS, dtype=np.int32)

    def __call__(self, text: str):
        np = self.np
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        mul, spread = np.uint32(0x01000193), np.uint32(0x9E3779B1)
        found = []
        h = c
        for n in range(2, ORDERS[-1] + 1):
            if len(c) < n:
                break
            h = h[:-1] * mul + c[n - 1:]
            if n in ORDERS:
                found.append((((h ^ (h >> np.uint32(15))) * spread) + np.uint32(n * 0x632BE5AB % (1 << 32))) >> np.uint32(32 - BITS))
        if not found:
            return np.zeros(0, dtype=np.uint32)
        bins = np.concatenate(found)
        place = np.arange(len(bins), dtype=np.int32)
        self.last[bins] = place  # the last place written stays: one per distinct number
        return bins[self.last[bins] == place]


def _fit(rows: list[tuple], total: tuple[float, float], cost: float, epochs: int):
    """(weights per feature, slope, offset) from [(feature numbers, label)]."""
    import numpy as np

    size = 1 << BITS
    counts = np.zeros((2, size))
    for bins, y in rows:
        counts[y, bins] += 1
    n = np.array([sum(1 for _, y in rows if y == k) for k in (0, 1)], dtype=float)
    seen = counts.sum(0) >= 3
    ratio = np.where(seen, np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2)), 0.0)
    train = [r for i, r in enumerate(rows) if i % 5]
    rest = [r for i, r in enumerate(rows) if not i % 5]
    if len({y for _, y in rest}) < 2 or len({y for _, y in train}) < 2:
        train = rest = rows
    scaled = [(b, ratio[b], 1.0 if y else -1.0) for b, y in train]
    norm = np.array([r @ r + 1.0 for _, r, _ in scaled])
    diag = np.full(len(scaled), norm.mean() / (2 * cost))
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(scaled))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(scaled)):
            b, r, y = scaled[i]
            g = y * (w[b] @ r + bias) - 1 + alpha[i] * diag[i]
            new = max(0.0, alpha[i] - g / (norm[i] + diag[i]))
            d = (new - alpha[i]) * y
            if d:
                w[b] += d * r
                bias += d
                moved = max(moved, abs(d) * norm[i] ** 0.5)
                alpha[i] = new
        if moved < 1e-3:
            break
    # logistic curve on the margins left out, each class with its share of all labels
    m = np.array([w[b] @ ratio[b] + bias for b, _ in rest])
    y = np.array([k for _, k in rest], dtype=float)
    held = np.array([(1 - y).sum(), y.sum()])
    mass = np.where(y == 1, total[1] / held[1], total[0] / held[0])
    mass /= mass.mean()
    goal = np.where(y == 1, (held[1] + 1) / (held[1] + 2), 1 / (held[0] + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        v = mass * p * (1 - p) + 1e-9
        grad = np.array([(mass * (p - goal) * m).sum() + 1e-3 * (a - 1), (mass * (p - goal)).sum() + 1e-3 * b])
        hess = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return w * ratio, max(a, 1e-3), bias * max(a, 1e-3) + b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          per_class: int = 4000, cost: float = 1.0, epochs: int = 30) -> dict:
    """Fit on at most ``per_class`` labelled texts of each class; the model has a fixed size.

    The sample's texts go to one task, which bounds it by 2 x ``per_class`` texts
    whatever the size of the tables.
    """
    lab = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    n = {r[0]: r[1] for r in lab.groupBy("y").count().collect()}  # at most two rows
    total = (float(n.get(0, 0)), float(n.get(1, 0)))
    share = total[1] / max(1.0, sum(total))
    if not total[0] or not total[1]:
        return {"share": share}
    rank = F.xxhash64(F.lit(29), F.col("id"))
    chosen = None
    for y in (0, 1):
        part = lab.where(F.col("y") == y).orderBy(rank, "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 x per_class rows of two numbers: a proven bound for the broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).withColumn("one", F.lit(1))

    def fit(sample):
        import pyarrow as pa

        grams = Grams()
        rows = sorted(zip(sample.column("id").to_pylist(), sample.column("y").to_pylist(), sample.column("text")))
        both = {y for _, y, _ in rows}
        if len(both) < 2:
            out = (b"", 0.0, 0.0)
        else:
            w, a, b = _fit([(grams(t.as_py()), y) for _, y, t in rows], total, cost, epochs)
            out = (w.astype("<f8").tobytes(), float(a), float(b))
        return pa.table({"w": pa.array([out[0]], pa.binary()), "a": [out[1]], "b": [out[2]]})

    found = texts.groupBy("one").applyInArrow(fit, "w binary, a double, b double").first()
    if found is None or not found["w"]:
        return {"share": share}
    return {"w": bytes(found["w"]), "a": found["a"], "b": found["b"], "share": share}


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the probability that a text is toxic; one pass over the scan, no shuffle."""
    if "w" not in model:
        return docs.withColumn(score_col, F.lit(float(model["share"])))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 doubles

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        m, grams = shared.value, Grams()
        w = np.frombuffer(m["w"], dtype="<f8")
        for part in parts:
            z = np.array([w[grams(t)].sum() if t else 0.0 for t in part], dtype=float) * m["a"] + m["b"]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    return docs.withColumn(score_col, probability(F.col(text_col)))
