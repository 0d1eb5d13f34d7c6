"""The pipeline's stages take effect; each is held against plain Python on its own input."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_llm_common import union_find
from test_llm_mixing_packing import poisson, tokens
from test_llm_near_duplicates import brute_links

import hashlib

from tidewatch.llm import language, toxicity
from tidewatch.llm.common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "mixing", "packing"]
    steps = [f for _, f in corpus_pipeline.STAGES]
    clean = steps[0](spark, docs, sf_dir).cache()
    score = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in score.where("score < 0.5").collect()}
    known = steps[1](spark, clean, sf_dir).cache()
    named = language.identify(clean, language.train(clean))
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in named.where("lang_pred <> 'und' and score >= 0.5").collect()}
    single = steps[2](spark, known, sf_dir).cache()
    texts = {r.doc_id: r.text for r in known.collect()}
    want = union_find(brute_links(texts))
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i in texts if want.get(i, i) == i)
    mixed = steps[3](spark, single, sf_dir).cache()
    source = {r.doc_id: r.source for r in single.collect()}
    n = Counter(source.values())
    total = sum(k ** 0.5 for k in n.values())
    times = Counter()
    for i, s in source.items():
        u = (int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        times[i] = poisson(u, len(source) * n[s] ** 0.5 / total / n[s])
    assert Counter(r.doc_id for r in mixed.collect()) == +times
    for d in (clean, known, single, mixed):
        assert d.columns == docs.columns and d.dtypes == docs.dtypes
    packed = steps[4](spark, mixed, sf_dir)
    got = Counter()
    for r in packed.select("doc_id", "length").collect():
        got[r.doc_id] += r.length
    assert got == Counter({i: k * len(tokens(texts[i])) for i, k in times.items() if k})


def test_stages_on_odd_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = docs.limit(30).unionByName(docs.limit(3)).unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (-1, "", "en", None, 0), (-2, None, None, "src0", None)], docs.schema))
    for frame in (odd, docs.where("false")):
        for _, f in corpus_pipeline.STAGES:
            assert f(spark, frame, sf_dir).agg(F.count(F.lit(1))).first()[0] >= 0
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
