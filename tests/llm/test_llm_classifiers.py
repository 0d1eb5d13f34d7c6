import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import html, language, queries, toxicity


def test_distinct_grams():
    grams = toxicity.Grams()
    a, b = grams("The cat. The cat."), grams("the CAT. the cat.")
    assert sorted(a) == sorted(b) and len(set(a.tolist())) == len(a)
    assert len(grams("")) == len(grams("ab")) == 0 and len(grams("abc")) == 1
    assert sorted(grams("x" * 200_000)) == sorted(grams("xxxxxx"))
    assert set(grams("🙂🙂é").tolist())


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op2_toxicity(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == docs and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    held = [(labels[i], r.score) for i, r in rows.items() if r.held_out and i in labels]
    pos, neg = [s for y, s in held if y], [s for y, s in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)])
    assert pos and auc > 0.9


def toy(spark, n=60):
    rng = random.Random(1)
    text = lambda bad: " ".join(rng.choices(["good", "calm", "plain", "river", "stone"], k=12)) + (" vile" if bad else "")
    docs = [(i, text(i % 3 == 0), 0.5) for i in range(n)]
    return (spark.createDataFrame(docs + [(None, None, None), (900, "", 1.0), (901, None, 1.0), docs[0]], "doc_id long, text string, score double"),
            spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)] + [(3, 0), (None, 1), (5, None), (7, 9)], "doc_id long, toxic int"))


def test_toxicity_edges(spark):
    docs, labels = toy(spark)
    model = toxicity.train(docs, labels, per_class=20)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 64 and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 60)
    assert len({r.score for r in got if not r.text}) == 1
    again = toxicity.score(docs.repartition(7), toxicity.train(docs.repartition(3), labels, per_class=20)).collect()
    assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in got}
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.where("false"))).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), model).count() == 0


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers

    return language.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def vocabulary():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}


def test_forward_sums_all_segmentations(pieces):
    known = {t for t in vocabulary() if language.LETTERS.fullmatch(t.removeprefix("▁")) or t == "▁"}
    order = {h: i for i, h in enumerate(pieces.keys.tolist())}
    rng = np.random.default_rng(3)
    prob = rng.random((pieces.size + 1, 2)) / pieces.size
    prob[-1] = 0

    def brute(word, lang):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
            p, a = 1.0, 0
            for e in ends:
                s = word[a:e]
                p *= prob[order[pieces._hash(s)], lang] if s in known else language.UNKNOWN if e - a == 1 else 0.0
                a = e
            total += p
        return np.log(total)

    words = ["▁the", "▁house", "▁a", "▁straße", "▁漢字", "▁ação", "▁zzqx"]
    got = language.word_scores(pieces, words, prob)
    for w, g in zip(words, got):
        assert np.allclose(g, [brute(w, 0), brute(w, 1)])


def test_expectation_raises_the_likelihood(pieces):
    words, counts = ["▁the", "▁then", "▁thing", "▁things"], np.array([5.0, 2, 3, 1])
    fits = [language._expectation(pieces, words, counts, r) for r in (1, 2, 5)]
    score = [(language.word_scores(pieces, words, np.append(p[:-1], 0)[:, None])[:, 0] * counts).sum() for p in fits]
    assert score[0] < score[1] < score[2] and abs(fits[2][:-1].sum() - 1) < 0.01


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    true = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_language_id(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(true) and len(rows) == len(true)
    held = [r.lang_pred == true[r.doc_id].lang for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean(held) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    docs = spark.createDataFrame(
        [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)]
        + [(100, None, "en"), (101, "", "de"), (102, "12 ... !!", "en"), (103, "the " * 50_000, None), (104, "und" * 20_000, None),
           (None, "der hund", None), (105, "漢字かな", None)], "doc_id long, text string, lang string")
    model = language.train(docs, per_lang=5)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert got[0].lang_pred == "en" and got[1].lang_pred == "de" and got[None].lang_pred == "de" and got[103].lang_pred == "en"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102))
    assert got[104].lang_pred in ("de", "en") and got[105].lang_pred in ("de", "en")
    assert language.identify(docs.where("false"), model).count() == 0
    none = language.train(docs.where("lang is null"))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


PAGES = {
    "<html><head><title>T</title><script>var a='</p><p>no';</script></head><body><nav><ul><li>Home</li></ul></nav>"
    "<div class='ad'>Buy</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>\n  part.<p>Second&nbsp;&eacute;</p></article>"
    "<footer>&copy; x</footer></body></html>": "Head & line First bold part. Second é",
    "<body><header>Site</header><main><p>Short.</p><p>" + "Long text here. " * 30 + "</p><p>End.</p><div id='comments'><p>" + "me too " * 50
    + "</p></div></main><aside>side</aside>": "Short. " + ("Long text here. " * 30).strip() + " End.",
    "": "", "plain text only": "plain text only", "<p>a<p>b": "a b", "<style>x{}</style><!-- c -->": "", "<p>unclosed <b>tag": "unclosed tag",
    "<article><p>one<br>two</p><form><input>f</form><p>3 &lt; 4</p></article>": "one two 3 < 4",
    "<body><div class='cookieBanner'>ok?</div><div><p>" + "body words " * 40 + "</p></div><div><a>1</a><a>2</a><a>3</a></div>":
        ("body words " * 40).strip(),
    "<article><p>" + "w " * 100_000 + "</p></article>": ("w " * 100_000).strip(),
    "</p></div><p>stray</p>": "stray", "<<<>>> a & b": None,
}


@pytest.mark.parametrize("page", list(PAGES))
def test_main_text(page):
    got = html.extract_text(page)
    assert PAGES[page] is None or got == PAGES[page]


@pytest.mark.parametrize("piece", ["<a ", "<!-- ", "&", "<", "</", "<div>", "<p>x", '<a href="', "<b>x</p>", "<![CDATA["])
def test_awkward_pages_take_linear_time(piece):
    import time

    for tail in ("", ">", "<p>end</p>"):
        began = time.process_time()
        html.extract_text(piece * 30_000 + tail)
        assert time.process_time() - began < 5


def test_layout_words_do_not_hide_content():
    assert html.extract_text("<body class='has-sidebar'><div class='no-sidebar page'><p>kept</p></div><div class='sidebar'>gone</div>") == "kept"


def test_pages_query_whole_table(spark, sf_dir):
    import html as entities
    import re

    got = {r.page_id: r for r in queries.op9_html_text(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", p.html, re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_extraction_edges(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (2, "", "t"), (3, "<p>x</p>", None)], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in html.extract(df).collect()) == [(1, ""), (2, ""), (2, ""), (3, "x")]
    assert html.extract(df.where("false")).count() == 0


def test_long_runs_are_scored_over_all_cuts():
    """Runs beyond the batch length against a plain forward pass in log space, blocks of starts included."""
    import math
    import random

    import numpy as np
    import public_tokenizers as P

    pieces = language.Pieces(P.path("piece_bpe_32k.model"))
    rng = random.Random(4)
    prob = np.random.default_rng(1).dirichlet(np.ones(pieces.size) * 0.05, 2).T
    prob = np.maximum(np.vstack([prob, np.zeros(2)]), 0)
    prob[:-1] = np.maximum(prob[:-1], language.FLOOR)
    words = [language.MARK + "".join(rng.choice("aeinrstэд漢字") for _ in range(n)) for n in (10, 31, 32, 90, 300)]

    def number(text):
        return int(pieces.find(np.array([pieces._hash(text)], dtype=np.uint64))[0])

    for w in words:
        alpha = [[0.0, 0.0]]
        for e in range(1, len(w) + 1):
            sums = []
            for lang in range(2):
                terms = []
                for k in range(1, min(e, pieces.longest) + 1):
                    p = number(w[e - k:e])
                    q = language.UNKNOWN if p == pieces.size and k == 1 else float(prob[p, lang])
                    if q > 0:
                        terms.append(alpha[e - k][lang] + math.log(q))
                top = max(terms)
                sums.append(top + math.log(sum(math.exp(t - top) for t in terms)))
            alpha.append(sums)
        np.testing.assert_allclose(language.word_scores(pieces, [w], prob)[0], alpha[-1], rtol=1e-9)
        np.testing.assert_allclose(language.long_score(pieces, w, prob, block=7), alpha[-1], rtol=1e-9)


def test_digits_and_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "plain words of a text", "en"), (2, "² ½ Ⅷ ① 12", None), (3, "漢字" * 200, None)], "doc_id long, text string, lang string")
    model = language.train(docs)
    got = {r.doc_id: r.lang_pred for r in language.identify(docs.select("doc_id", "text"), model).collect()}
    assert got == {1: "en", 2: "und", 3: "en"}
