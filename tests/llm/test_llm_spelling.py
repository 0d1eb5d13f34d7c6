"""Spelling variants against plain Python."""

import collections
import random
import re
import zlib

import pytest

from tidewatch.llm import queries, spelling


def edits(a, b):
    """Plain edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def counts(rows):
    found = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{low}".encode())
            if h % 199 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1:]
            found[low] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def neighbours(words):
    """Near words by their texts with one place left open."""
    open_at, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            open_at[w[:i] + "*" + w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in words:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for group in open_at.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain(rows):
    words = counts(rows)
    near, forms = neighbours(words), {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n, len(near[w]), words[forms[w]] if forms[w] else None)
    return out


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_one_edit():
    rng = random.Random(2)
    for _ in range(4000):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(0, 6))) for _ in range(2))
        assert spelling.one_edit(a, b) == (edits(a, b) == 1)


def test_trie_finds_all_near_words():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcxyé") for _ in range(rng.randrange(3, 6))) for _ in range(500)})
    group_of = {"a": 0, "b": 1, "c": 1, "x": 2}
    paths = [spelling.path_of(w, group_of, 4) for w in words]
    trie = spelling.Trie(paths)
    for w, p in zip(words, paths):
        hits = {words[i] for i in trie.search(p, 1, 1)}
        assert {x for x in words if edits(w, x) == 1} <= hits
        assert all(sum(max(b - a, 0) for a, b in zip(p, spelling.path_of(x, group_of, 4))) <= 1 for x in hits)


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_near_pairs_match_plain(spark, crowd):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("etanohé") for _ in range(rng.randrange(6, 8))) for _ in range(1200)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    pairs = [tuple(r) for r in spelling.near_pairs(df, crowd=crowd).collect()]
    near = neighbours(set(words))
    assert sorted(pairs) == sorted((w, x) for w in near for x in near[w])
    assert len(pairs) > 100


def test_variants_follow_forms(spark):
    rng = random.Random(11)
    rows, base = [], ["resolution", "resolutions", "resolutoon", "resolutooon", "Übermorgen", "übermorgen", "Colour", "color", "colours"]
    for i in range(400):
        rows.append((rng.choice([i, None]), " ".join(rng.choice(base[:1 + rng.randrange(len(base))]) for _ in range(30))))
    rows += [(7, "resolutooonn " * 6 + "abcdeff " * 5 + "abcdefg " * 30 + "abcdefh " * 30), (8, None), (9, ""), (10, "abc " * 50)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = found(spelling.spelling_variants(df))
    assert got == plain(rows)
    assert sum(v[0] is not None for v in got.values()) >= 3


def test_no_frequent_word(spark):
    df = spark.createDataFrame([(1, "seldom words here"), (None, None)], "doc_id long, text string")
    assert spelling.spelling_variants(df).count() == 0
    assert spelling.spelling_variants(df.where("false")).count() == 0


def test_query_matches_plain(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.op13_spelling_variants(spark, sf_dir)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = found(df)
    assert got == plain(docs) and any(v[0] for v in got.values())
