import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import chat, fingerprint, queries, url_rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return rest[:end].translate(LOWER), tail[:stop]


def judged(url, rules):
    h, p = host_path(url)
    fit = [(len(rh + rp), rh + rp, a) for a, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
    return (h, p, max(fit)[1], max(fit)[2]) if fit else (h, p, None, "allow")


URLS = [None, "", "no scheme", "http://", "://", "https://A.Example.ORG/es/x?y#z", "http://example.org/en/19", "http://example.org/en/2",
        "http://notexample.org/es/", "http://org", "http://org/", "http://x.com/de/1", "http://x.com/fr?/de/", "http://com/de/",
        "http://a.b.c.d.e.example.org/es/q", "ftp://example.org?x=/es/", "http://example.org#/es/", "http://ex/ample.org://z/es/",
        "http://ÄB.org/ü", "http://example.org./es/", "http://example.org/es/" + "x" * 50_000, "http://" + "a." * 3000 + "org/",
        "http://example.org/ES/", "http://.org/x", "http://example.org/es/", "http://example.org/es/"]
NESTED = [("block", "org", "/"), ("allow", "org", "/a/"), ("block", "org", "/a/b"), ("allow", "x.org", "/a"), ("block", "y.x.org", "/a/b/c")]


@pytest.mark.parametrize("rules", [queries.RULES, NESTED, []])
def test_rules_against_plain_python(spark, rules):
    rng = random.Random(1)
    urls = URLS + ["http://" + rng.choice(["", "y.", "z.", "y.x.", "x."]) + "org/" + "/".join(rng.choices(["a", "b", "c", "bc"], k=rng.randrange(4)))
                   for _ in range(80)]
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    table = spark.createDataFrame([*rules, ("block", None, "/"), ("block", "com", None)], "action string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, table).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_rules_of_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(pages, spark.createDataFrame(NESTED, "action string, host string, path string")).count() == 0


def rendered(turns):
    return [f"<|{r}|>\n{t}<|end|>\n" for r, t in turns]


def test_preference_prefix_against_plain_python(spark):
    rng = random.Random(2)
    pairs, rows = {}, []
    for p in range(60):
        base = [(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.randrange(6))]
        a = base + [(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.randrange(3))]
        b = base[:rng.randrange(len(base) + 1)] + [("assistant", rng.choice("abc"))] * rng.randrange(3)
        pairs[p] = (a, b)
        for side, turns in (("chosen", a), ("rejected", b)):
            rows += [(p, side, i * 10, r, t, "x") for i, (r, t) in enumerate(turns)]
    rows += rows[:15]  # repeated rows count once
    got = chat.preference_turns(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, segment string"))
    parts = {}
    for r in got.orderBy("pair_id", "segment", "turn", "place").collect():
        parts.setdefault((r.pair_id, r.segment), []).append(r.rendered)
        trained = r.segment != "prompt" and r.role == "assistant"
        assert (r.mask_chars > 0) == trained
        if trained:
            assert r.rendered[r.mask_start:r.mask_start + r.mask_chars].endswith("<|end|>\n") and r.rendered[:r.mask_start] == "<|assistant|>\n"
    for p, (a, b) in pairs.items():
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert parts.get((p, "prompt"), []) == rendered(a[:n])
        assert parts.get((p, "chosen"), []) == rendered(a[n:]) and parts.get((p, "rejected"), []) == rendered(b[n:])


def test_preference_nulls_ties_and_empty(spark):
    kind = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(None, None, None, None), (None, 1, "assistant", "n"), (1, 0, "user", "q"), (1, 1, "assistant", "b"),
                                (1, 1, "assistant", "a"), (2, 0, "user", "only")], kind)
    got = chat.preference_turns(chat.swapped_answers(df)).collect()
    assert {(r.pair_id, r.segment) for r in got} >= {(None, "prompt"), (None, "chosen"), (None, "rejected"), (1, "rejected"), (2, "prompt")}
    assert [r.rendered for r in got if r.pair_id == 1 and r.segment == "rejected"] == ["<|assistant|>\nn<|end|>\n"]
    assert chat.preference_turns(chat.swapped_answers(df.where("false"))).count() == 0


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(n))


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketch_estimates(spark):
    rng = random.Random(4)
    a = words(rng, 3000)
    cases = [(a, a), (a, a[:len(a) // 2]), (a, words(rng, 3000)), (a, a + " " + words(rng, 1000)), ("", ""), (None, "x y"), (None, None),
             ("one two", "one  TWO "), ("one two", "two one"), (words(rng, 40), words(rng, 40)), ("w " * 100_000, "w w w w w")]
    k = 128
    x, y = fingerprint.sketch(F.col("a"), k), fingerprint.sketch(F.col("b"), k)
    got = spark.createDataFrame(cases, "a string, b string").select(x.alias("x"), y.alias("y")).select(
        "x", "y", fingerprint.resemblance(F.col("x"), F.col("y"), k).alias("r"), fingerprint.containment(F.col("y"), F.col("x"), k).alias("c"),
        fingerprint.distinct_shingles(F.col("x"), k).alias("n"), fingerprint.as_text(F.col("x")).alias("t")).collect()
    for (p, q), g in zip(cases, got):
        s, t = shingles(p or ""), shingles(q or "")
        true = len(s & t) / len(s | t) if s | t else 1.0
        assert abs(g.r - true) < (1e-9 if len(s | t) < k else 0.15), (true, g.r)
        assert abs(g.c - (len(s & t) / len(t) if t else 1.0)) < 0.2
        assert abs(g.n - len(s)) <= (0 if len(s) < k else 0.35 * len(s))
        assert len(g.x) == min(k, len(s)) and len(g.t) == 16 * len(g.x) and list(g.x) == sorted(g.x)
    assert got[7].t == got[7].t.lower() and got[7].x == got[7].y


def test_sketches_merge(spark):
    rng = random.Random(6)
    parts = [(i % 2, " ".join(f"w{rng.randrange(500)}" for _ in range(100))) for i in range(10)]
    df = spark.createDataFrame(parts, "k int, text string").withColumn("s", fingerprint.sketch(F.col("text"), 64))
    merged = {r.k: list(r.s) for r in fingerprint.merge_parts(df, ["k"], "s", 64).collect()}
    every = {}
    for r in df.select("k", fingerprint.shingle_hashes(F.col("text")).alias("h")).collect():
        every.setdefault(r.k, set()).update(r.h)
    assert merged == {k: sorted(v)[:64] for k, v in every.items()}


def test_fingerprint_query_against_plain_python(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    order = sorted(docs)
    got = {r.doc_id: r for r in queries.op4_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    err = []
    for n, i in enumerate(order):
        t, nxt = docs[i], docs[order[(n + 1) % len(order)]]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        s, e = shingles(t), shingles(edited)
        err.append(abs(r.near_edited - (len(s & e) / len(s | e) if s | e else 1.0)))
    assert max(err) < 0.2 and sum(err) / len(err) < 0.03
    same = {}
    for i in order:
        same.setdefault(docs[i], set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_preference_records_assemble_pairs(spark):
    """One record per pair: prompt once, completions with the trained spans at their places."""
    from tidewatch.llm import chat

    long_text = "é\U0001F600 word " * 3000
    turns = [(1, s, i, r, t) for s, tail in (("chosen", "good"), ("rejected", "bad"))
             for i, r, t in [(0, "system", "be kind"), (1, "user", long_text), (2, "assistant", "hm"), (3, "user", "and?"), (4, "assistant", tail)]]
    turns += [(2, s, 0, "user", "same") for s in ("chosen", "rejected")] + [(None, "chosen", 0, "assistant", None), (None, "rejected", 0, "user", "x")]
    turns += [(3, "chosen", i, "assistant", "t") for i in range(30)]
    rows = chat.preference_turns(spark.createDataFrame(turns, "pair_id long, side string, turn int, role string, text string").repartition(5))
    got = {r.pair_id: r for r in chat.preference_records(rows, most_turns=20).collect()}
    assert set(got) == {1, 2, None}   # the pair of 30 turns stays in turn form
    one = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    a = got[1]
    assert a.prompt == one("system", "be kind") + one("user", long_text) + one("assistant", "hm") + one("user", "and?")
    assert (a.chosen, a.rejected) == (one("assistant", "good"), one("assistant", "bad"))
    for text, spans, said in ((a.chosen, a.chosen_spans, "good"), (a.rejected, a.rejected_spans, "bad")):
        assert [text[s.start:s.start + s.chars] for s in spans] == [f"{said}<|end|>\n"]
    assert (got[2].prompt, got[2].chosen, got[2].rejected, got[2].chosen_spans) == (one("user", "same"), "", "", [])
    assert [got[None].chosen[s.start:s.start + s.chars] for s in got[None].chosen_spans] == ["<|end|>\n"] and got[None].rejected_spans == []
    whole = {r.pair_id: r for r in chat.preference_records(rows).collect()}[3]
    assert len(whole.chosen_spans) == 30 and all(whole.chosen[s.start:s.start + s.chars] == "t<|end|>\n" for s in whole.chosen_spans)
    assert chat.preference_records(rows.where("false")).count() == 0
