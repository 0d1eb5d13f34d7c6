"""One registered query per training-data operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, dart_minhash, fingerprint, fm_index, hnsw, html, language, mixing, packing, spelling, toxicity, url_rules
from .common import id_fold, table, with_next

#: The rules of the registered query as (action, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(id_fold(F.col("doc_id"), 5) != 0))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(id_fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(docs, "doc_id", "text", {"text": "next_text", "own": "next_own"}, {"own": fingerprint.sketch(F.col("text"))})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    d = d.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "next_own",
                 fingerprint.sketch(F.col("edited")).alias("other"))
    return d.select("doc_id", "n_chars", "edited_sha256", fingerprint.as_text(F.col("own")).alias("fingerprint"),
                    fingerprint.as_text(F.col("other")).alias("edited_fingerprint"),
                    fingerprint.resemblance(F.col("own"), F.col("other")).alias("near_edited"),
                    fingerprint.resemblance(F.col("own"), F.col("next_own")).alias("near_next"))


def op5_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_turns(chat.swapped_answers(table(spark, sf_dir, "conversations")))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classes = dart_minhash.near_duplicates(docs)
    ids = docs.select("doc_id").distinct()
    return ids.join(classes, ids.doc_id == classes.id, "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = id_fold(F.col("doc_id"), 4)
    model = language.train(docs.where(fold != 2))
    named = language.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fm_index.remove_repeats(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked_documents(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_toxicity, op3_url_rules, op4_fingerprints, op5_chat_preferences,
                                   op6_minhash_dedup, op7_language_id, op8_packing, op9_html_text, op10_source_mixing,
                                   op11_substring_dedup, op12_tokenizer_alignment, op13_spelling_variants, pipeline)}

ORACLE = {
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT a AS id, b AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       least(e.vec_id, coalesce(m.low, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(m.low, e.vec_id)) AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings) e LEFT JOIN (SELECT id, min(other) AS low FROM reach GROUP BY id) m ON m.id = e.vec_id""",
    "op3_url_rules": """
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, regexp_replace(rest, '[?#](.|\n)*$', '') AS cut FROM p),
s AS (SELECT page_id, translate(coalesce(raw_host, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(substr(cut, length(raw_host) + 1), '') AS path FROM q),
r(action, h, pa) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT s.page_id, s.host, s.path, max(length(h || pa)) AS n FROM s
      JOIN r ON (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, pa) GROUP BY ALL)
SELECT s.page_id, s.host, s.path, r.h || r.pa AS rule, coalesce(r.action, 'allow') AS verdict
FROM s LEFT JOIN m ON m.page_id = s.page_id AND m.host = s.host AND m.path = s.path
LEFT JOIN r ON (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, pa) AND length(h || pa) = m.n""",
    "op5_chat_preferences": """
WITH t AS (SELECT conv_id AS p, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
answers AS (SELECT p, max(turn) AS last_at FROM t WHERE role = 'assistant' GROUP BY p),
finals AS (SELECT a.p, a.last_at, max(t.text) AS text FROM answers a JOIN t ON t.p = a.p AND t.turn = a.last_at AND t.role = 'assistant' GROUP BY ALL),
swap AS (SELECT p, last_at, coalesce(lead(text) OVER (ORDER BY p), first_value(text) OVER (ORDER BY p)) AS text FROM finals),
chosen AS (SELECT DISTINCT p, turn, role, text FROM t),
rejected AS (SELECT DISTINCT t.p, t.turn, t.role, t.text FROM t LEFT JOIN swap s ON s.p = t.p WHERE s.last_at IS NULL OR t.turn < s.last_at
             UNION SELECT p, last_at, 'assistant', text FROM swap),
c AS (SELECT *, row_number() OVER (PARTITION BY p, turn ORDER BY role, text) AS place FROM chosen),
r AS (SELECT *, row_number() OVER (PARTITION BY p, turn ORDER BY role, text) AS place FROM rejected),
b AS (SELECT coalesce(c.p, r.p) AS p, coalesce(c.turn, r.turn) AS turn, coalesce(c.place, r.place) AS place,
             c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text
      FROM c FULL JOIN r ON c.p = r.p AND c.turn = r.turn AND c.place = r.place),
f AS (SELECT *, bool_or(c_role IS DISTINCT FROM r_role OR c_text IS DISTINCT FROM r_text)
                OVER (PARTITION BY p ORDER BY turn, place) AS forked FROM b),
o AS (SELECT p, 'prompt' AS segment, turn, place, c_role AS role, c_text AS text FROM f WHERE NOT forked
      UNION ALL SELECT p, 'chosen', turn, place, c_role, c_text FROM f WHERE forked AND c_role IS NOT NULL
      UNION ALL SELECT p, 'rejected', turn, place, r_role, r_text FROM f WHERE forked AND r_role IS NOT NULL)
SELECT p AS pair_id, segment, turn, place, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
       CAST(CASE WHEN segment <> 'prompt' AND role = 'assistant' THEN length(role) + 5 ELSE 0 END AS BIGINT) AS mask_start,
       CAST(CASE WHEN segment <> 'prompt' AND role = 'assistant' THEN length(text) + 8 ELSE 0 END AS BIGINT) AS mask_chars
FROM o""",
    "op10_source_mixing": """
WITH RECURSIVE n AS (SELECT source, count(*) AS rows, sqrt(count(*)) AS w FROM documents GROUP BY source),
rate AS (SELECT source, (SELECT sum(rows) FROM n)::DOUBLE * w / (SELECT sum(w) FROM n) / rows AS rate FROM n),
cdf(source, rate, k, log_p, cdf) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM rate
  UNION ALL SELECT source, rate, k + 1, log_p + ln(rate) - ln(k + 1), cdf + exp(log_p + ln(rate) - ln(k + 1))
  FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 24)),
d AS (SELECT *, (('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
      FROM documents),
t AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(c.k) AS times FROM d
      LEFT JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.cdf < d.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS BIGINT) AS copy,
       md5('17/' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM t, LATERAL (SELECT unnest(range(times)) AS copy)""",
    "op11_substring_dedup": """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS pos FROM w),
k AS (SELECT doc_id, pos, md5(array_to_string(ws[pos:pos + 19], ' ')) AS h FROM s),
early AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS turn FROM k),
gone AS (SELECT DISTINCT doc_id, pos + unnest(range(20)) AS place FROM early WHERE turn > 1),
g AS (SELECT doc_id, list(place) AS places, count(*) AS n FROM gone GROUP BY doc_id),
r AS (SELECT w.doc_id, ws, coalesce(places, []) AS places, coalesce(n, 0) AS n FROM w LEFT JOIN g ON g.doc_id = w.doc_id),
x AS (SELECT doc_id, len(ws) AS n_words, n, ws, places, unnest(range(1, greatest(len(ws), 1) + 1)) AS pos FROM r),
kept AS (SELECT x.doc_id, string_agg(x.ws[x.pos], ' ' ORDER BY x.pos) AS kept FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.place = x.pos
         WHERE gone.place IS NULL GROUP BY x.doc_id)
SELECT r.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM r LEFT JOIN kept ON kept.doc_id = r.doc_id""",
}
