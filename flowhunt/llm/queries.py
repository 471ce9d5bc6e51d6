"""The catalogue of this package: one query per operator, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowhunt.llm import (
    chosen_path, decontaminate, exact_dedup, hard_negatives, importance, language_id, license_scan, packing, piece_coding, secrets,
    suffix_dedup, token_counts, toxicity,
)
from flowhunt.llm.common import documents, fold
from flowhunt.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL, BYTE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.scan_secrets(docs, secrets.fit_ratios(docs))
    every = F.array_sort(F.concat("base", "added"))
    return found.select(
        "doc_id", *[secrets.count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"),
        secrets.spans_text(every).alias("spans"),
        F.size("added").cast("long").alias("n_markov"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.leaks(documents(spark, sf_dir), benchmark, per_window=True).drop("print")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return license_scan.scan_licenses(docs, license_scan.token_order(docs))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit_dictionaries(language_id.labelled(docs))
    found = language_id.identify(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = toxicity.labelled_sample(docs, labels)
    terms = toxicity.learn_lexicon(sample)
    found = toxicity.score(docs, terms, toxicity.fit(sample, terms))
    return found.withColumn("held_out", fold("doc_id", 5) == 0)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join_similar(documents(spark, sf_dir))


def op9_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_coding.encode_documents(documents(spark, sf_dir), public_tokenizers.path(PIECE_MODEL))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(PIECE_MODEL))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance.importance(documents(spark, sf_dir), benchmark).select("doc_id", "n_features", "weight", "score", "rank")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(BYTE_MODEL), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    packed = packing.pack(packing.token_pieces(documents(spark, sf_dir), *paths))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0, label=label)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_license_scan": op4_license_scan,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_piece_coding": op9_piece_coding,
    "op10_token_counts": op10_token_counts,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_packing": op12_packing,
    "op13_hard_negatives": op13_hard_negatives,
}
