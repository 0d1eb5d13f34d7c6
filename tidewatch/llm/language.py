"""Language identification by segmentation-marginalised unigrams.

Per language, every piece of a fixed public vocabulary has a probability; a
word's probability is the sum, over all ways to cut it into pieces, of the
product of theirs, found by a forward pass over its characters.  A text's score
for a language is the sum of its words' log probabilities.

The piece probabilities are fitted by expectation-maximisation (forward and
backward passes over word counts) on at most ``per_lang`` texts of each
language, the first by a hash of their ids.  Scoring reads every whole text.

Words are runs of letters, lower-cased, with the vocabulary's word-start mark.
A character outside the vocabulary is a piece of a small fixed probability, so
every word can be cut.  Runs of any length are scored over all their cuts: beyond
31 letters by a forward pass that keeps the last alphas, rescaled on the way.
Fitting alone cuts such runs into stretches of 31 letters.

Defined cases: null text and text without a letter have the language ``und``
and score 0; null languages and texts are not learnt from; without any learnt
language all texts are ``und``; equal scores go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship

ship(__name__)

LETTERS = regex.compile(r"\p{L}+")
SHORT = 31       # longest run that is scored in a batch of equal lengths
MARK = "▁"
UNKNOWN = 1e-6   # probability of a character that no piece covers
BROADCAST_BYTES = 8_000_000   # largest list of sampled ids that is broadcast
FLOOR = 1e-7     # probability of a piece that the sample never uses


class Pieces:
    """The vocabulary's pieces without control and byte pieces, found by hash of code points."""

    def __init__(self, model_file: str):
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        texts = sorted({sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())
                        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))})
        texts = [t for t in texts if LETTERS.fullmatch(t.removeprefix(MARK)) or t == MARK]
        self.np, self.longest = np, max(map(len, texts))
        keys = np.array([self._hash(t) for t in texts], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.size = keys[order], len(texts)
        bits = 16  # a first table by the top bits narrows the search to a few keys
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int64)
        self.steps = int(np.diff(np.append(self.start, len(keys))).max())

    def _hash(self, text: str) -> int:
        h = 0
        for ch in text:
            h = ((h + ord(ch) + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
            h ^= h >> 29
        return h

    def find(self, h):
        """Piece numbers of hashes; ``size`` where there is none."""
        np = self.np
        at = self.start[(h >> self.shift).astype(np.int64)]
        out = np.full(h.shape, self.size, dtype=np.int32)
        for _ in range(self.steps):
            at = np.minimum(at, self.size - 1)
            hit = self.keys[at] == h
            out[hit] = at[hit]
            at = at + 1
        return out

    def spans(self, chars):
        """For words of one length as a code-point matrix: {(start, length): piece numbers}."""
        np = self.np
        n, width = chars.shape
        c = chars.astype(np.uint64) + np.uint64(1)
        mul, found = np.uint64(0x9E3779B97F4A7C15), {}
        for s in range(width):
            h = np.zeros(n, dtype=np.uint64)
            for k in range(1, min(self.longest, width - s) + 1):
                h = (h + c[:, s + k - 1]) * mul
                h ^= h >> np.uint64(29)
                found[s, k] = self.find(h)
        return found


def _by_length(words: list[str], block: int = 20_000):
    """(places, code-point matrix) of words of one length, in bounded blocks."""
    import numpy as np

    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, places in sorted(groups.items()):
        for a in range(0, len(places), block):
            at = places[a:a + block]
            yield np.array(at), np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n)


def _forward(spans: dict, width: int, prob):
    """alpha[e]: probability of the first e characters over all their cuts; prob has a last row for no piece."""
    import numpy as np

    n = len(spans[0, 1])
    none = len(prob) - 1
    alpha = [np.ones((n, prob.shape[1]))]
    for e in range(1, width + 1):
        a = np.zeros((n, prob.shape[1]))
        for s in range(max(0, e - 64), e):
            if (s, e - s) in spans:
                p = spans[s, e - s]
                if e - s == 1:
                    a += alpha[s] * np.where((p == none)[:, None], UNKNOWN, prob[p])
                else:
                    hit = np.flatnonzero(p != none)
                    if len(hit):
                        a[hit] += alpha[s][hit] * prob[p[hit]]
        alpha.append(a)
    return alpha


def long_score(pieces: Pieces, word: str, prob, block: int = 4096):
    """Log probability of one word of any length per language.

    Only the alphas of the last ``longest`` places are kept, relative to the
    current one; pieces are looked up for a block of starts at a time.
    """
    import numpy as np

    none, reach = len(prob) - 1, pieces.longest
    chars = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    mul, n = np.uint64(0x9E3779B97F4A7C15), len(word)
    ring = np.zeros((reach, prob.shape[1]))            # alphas of places e - 1, e - 2, ...
    ring[0] = 1
    scale = np.zeros(prob.shape[1])
    found = np.full((reach, 0), none, dtype=np.int64)  # found[k - 1, s]: the piece of length k that starts at s
    first = 0                                          # the start of found's first column
    lengths = np.arange(reach)
    for e in range(1, n + 1):
        if e - 1 - first >= found.shape[1]:
            start = first + found.shape[1]
            stop = min(n, start + block)
            padded = np.concatenate([chars[start:stop + reach], np.zeros(max(0, stop + reach - n), np.uint64)])
            h, more = np.zeros(stop - start, np.uint64), np.full((reach, stop - start), none, dtype=np.int64)
            for k in range(reach):
                h = (h + padded[k:k + stop - start]) * mul
                h ^= h >> np.uint64(29)
                fits = np.arange(start, stop) + k < n
                more[k, fits] = pieces.find(h)[fits]
            keep = max(0, found.shape[1] - reach)      # starts that later places still reach back to
            found, first = np.concatenate([found[:, keep:], more], axis=1), first + keep
        at = e - 1 - lengths                           # starts of pieces of length 1, 2, ... that end here
        live = at >= 0
        p = found[lengths[live], at[live] - first]
        weight = prob[p]
        if p[0] == none:
            weight[0] = UNKNOWN
        a = (ring[live] * weight).sum(axis=0)
        scale += np.log(a)
        ring[1:] = ring[:-1] / a
        ring[0] = 1
    return scale


def word_scores(pieces: Pieces, words: list[str], prob):
    """Log probability of every word per language; prob is (pieces + 1) x languages."""
    import numpy as np

    out = np.zeros((len(words), prob.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= SHORT + 1]
    for at, chars in _by_length([words[i] for i in short]):
        out[np.array(short)[at]] = np.log(_forward(pieces.spans(chars), chars.shape[1], prob)[-1])
    for i, w in enumerate(words):
        if len(w) > SHORT + 1:
            out[i] = long_score(pieces, w, prob)
    return out


def marked_words(text: str) -> list[str]:
    """Runs of letters, lower-cased, with the word-start mark."""
    return [MARK + w for w in LETTERS.findall(text.lower())]


def stretches(text: str) -> list[str]:
    """``marked_words`` for fitting, long runs cut."""
    found = LETTERS.findall(text.lower())
    if found and max(map(len, found)) > SHORT:
        return [p for w in found for p in ([MARK + w] if len(w) <= SHORT else
                                           [MARK + w[:SHORT], *(w[i:i + SHORT] for i in range(SHORT, len(w), SHORT))])]
    return [MARK + w for w in found]


def _expectation(pieces: Pieces, words: list[str], counts, rounds: int):
    """Piece probabilities of one language after some rounds of expectation-maximisation."""
    import numpy as np

    prob = np.full((pieces.size + 1, 1), 1.0 / pieces.size)
    prob[-1] = 0
    kept = [(at, chars.shape[1], pieces.spans(chars)) for at, chars in _by_length(words)]
    for _ in range(rounds):
        gain = np.zeros(pieces.size + 1)
        for at, width, spans in kept:
            alpha = _forward(spans, width, prob)
            n = len(at)
            beta = [np.zeros((n, 1)) for _ in range(width)] + [np.ones((n, 1))]
            for s in range(width - 1, -1, -1):
                for k in range(1, min(pieces.longest, width - s) + 1):
                    p = spans[s, k]
                    w = prob[p] if k > 1 else np.where((p == pieces.size)[:, None], UNKNOWN, prob[p])
                    beta[s] += w * beta[s + k]
            whole = counts[at] / alpha[-1][:, 0]
            for (s, k), p in spans.items():
                use = alpha[s][:, 0] * prob[p][:, 0] * beta[s + k][:, 0] * whole
                gain += np.bincount(p, weights=use, minlength=pieces.size + 1)
        gain[-1] = 0
        prob = (np.maximum(gain / max(gain.sum(), 1e-300), FLOOR))[:, None]
        prob[-1] = 0
    return prob[:, 0]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_lang: int = 1500, rounds: int = 4, vocabulary: str = "piece_bpe_32k.model") -> dict:
    """Piece probabilities per language, from at most ``per_lang`` texts of each.

    The sample's words are counted by Spark; each language's counts, bounded by
    its sample, are fitted in one task.  To the driver comes one vector of the
    vocabulary's size per language.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    w = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(31), F.col("id")), "id")
    chosen = usable.select("id", "lang").withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_lang).select("id", "lang").distinct()
    size = chosen.agg(F.sum(F.octet_length("lang") + 32)).first()[0] or 0  # bytes, at most per_lang rows a language
    sample = usable.join(F.broadcast(chosen) if size <= BROADCAST_BYTES else chosen, ["id", "lang"], "left_semi")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from collections import Counter

        for b in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                seen.setdefault(lang, Counter()).update(stretches(text))
            rows = [(lang, word, n) for lang, c in seen.items() for word, n in c.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))],
                                                 names=["lang", "word", "n"])

    counts = sample.select("lang", "text").mapInArrow(cut, "lang string, word string, n long") \
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fit(rows):
        import numpy as np
        import public_tokenizers
        import pyarrow as pa

        pieces = Pieces(public_tokenizers.path(vocabulary))
        pairs = sorted(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()))
        prob = _expectation(pieces, [p[0] for p in pairs], np.array([p[1] for p in pairs], dtype=float), rounds)
        return pa.table({"lang": [rows.column("lang")[0].as_py()], "prob": pa.array([prob.astype("<f8").tobytes()], pa.binary())})

    found = counts.groupBy("lang").applyInArrow(fit, "lang string, prob binary").collect()
    return {"vocabulary": vocabulary, "prob": dict(sorted((r["lang"], bytes(r["prob"])) for r in found))}


def identify(docs: DataFrame, model: dict, text_col: str = "text", lang_col: str = "lang_pred",
             score_col: str = "score") -> DataFrame:
    """Add the likeliest language and its posterior probability (equal priors); one pass, no shuffle."""
    if not model["prob"]:
        return docs.withColumn(lang_col, F.lit("und")).withColumn(score_col, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import public_tokenizers

        class Numbers(dict):
            def __missing__(self, word):
                self[word] = n = len(self)
                return n

        m = shared.value
        names = list(m["prob"])
        prob = np.stack([np.frombuffer(m["prob"][k], dtype="<f8") for k in names], axis=1)
        pieces = Pieces(public_tokenizers.path(m["vocabulary"]))
        known, table, filled = Numbers(), np.zeros((1 << 16, len(names))), 0
        for part in parts:
            texts = part.tolist()
            langs, scores = [], []
            for a in range(0, len(texts), 500):  # words of 500 texts are scored together
                numbered, new = [], []
                for t in texts[a:a + 500]:
                    ws = marked_words(t) if t else []
                    numbered.append(np.fromiter(map(known.__getitem__, ws), dtype=np.int64, count=len(ws)))
                if len(known) > filled:
                    new = list(known)[filled:] if filled == 0 else _tail(known, filled)
                    if len(known) > len(table):
                        table = np.concatenate([table, np.zeros((max(len(known) - len(table), len(table)), len(names)))])
                    table[filled:len(known)] = word_scores(pieces, new, prob)
                    filled = len(known)
                for ids in numbered:
                    if not len(ids):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    z = table[ids].sum(axis=0)
                    best = int(z.argmax())
                    langs.append(names[best])
                    scores.append(float(1 / np.exp(z - z[best]).sum()))
                if len(known) > 400_000:  # the words remembered in a task are bounded
                    known, filled = Numbers(), 0
            yield pd.DataFrame({"lang": langs, "score": scores})

    out = docs.withColumn("_judged", judge(F.col(text_col)))
    return out.withColumn(lang_col, F.col("_judged.lang")).withColumn(score_col, F.col("_judged.score")).drop("_judged")


def _tail(words: dict, start: int) -> list[str]:
    """Keys from place ``start`` on, newest last."""
    from itertools import islice

    newest = list(islice(reversed(words), len(words) - start))
    return newest[::-1]
