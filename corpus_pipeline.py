"""Corpus pipeline: toxicity, language, near-duplicates, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet to the checkpoint folder and rereads it as the next
stage's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import dart_minhash, language, mixing, packing, toxicity
from tidewatch.llm.common import table
from tidewatch.session import cut_lineage, drop_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the classifier stay (empty texts as the bare intercept says)."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col="_toxic").where("_toxic < 0.5").drop("_toxic")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a probability of at least one half stay."""
    model = language.train(docs)
    named = language.identify(docs, model, lang_col="_lang", score_col="_sure")
    return named.where("_lang <> 'und' and _sure >= 0.5").drop("_lang", "_sure")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one of smallest id."""
    return dart_minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated to weights of the square root of their sizes, copies shuffled."""
    return mixing.replicate(docs).drop(*mixing.ADDED)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of at most 2048 tokens, with their token ids."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("language", keep_known_language), ("near_duplicates", drop_near_duplicates),
          ("mixing", mix_sources), ("packing", pack_sequences)]

#: Trained models and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_table(before)  # consumed: its result is written
        before = docs
    return docs
