"""Corpus clean-up: language, exact copies, near copies, benchmark leaks, then piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. ``run`` writes each stage to the shared folder and reads it back as the next one's input.

Defined cases: null, empty and letterless texts go at the first stage; of equal texts the largest doc_id
stays, of a near-copy class the smallest (a null one counts as larger than all others); repeated rows are one
row from the second stage on. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowhunt.llm import chosen_path, decontaminate, exact_dedup, language_id, piece_coding
from flowhunt.llm.queries import PIECE_MODEL
from flowhunt.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.fit_dictionaries(language_id.labelled(docs)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.keep_one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), per_window=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_coding.encode_documents(docs, public_tokenizers.path(PIECE_MODEL))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("piece_coding", encode),
]

# Compression, the learned sample and Viterbi have no SQL form; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
