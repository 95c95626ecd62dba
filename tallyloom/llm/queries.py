"""The corpus operators' queries over the synthetic tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprints, jaccard, language, minhash, mixing, negatives, packing, periodic, quality, substring_dedup, token_counts, toxicity
from .shared import fold, table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def held_out(df: DataFrame, n: int, rest: int) -> DataFrame:
    """With held_out; a row without a doc_id has no label to hold out: false."""
    return df.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), n) == rest, F.lit(False)))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    return held_out(quality.quality(docs, model), 3, 1).select("doc_id", "held_out", "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), 3) != 1)))
    return held_out(language.identify(docs, model), 3, 1).select("doc_id", "held_out", "lang_pred", "score")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=4, share=85)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), width=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    return mixed.select("doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return held_out(toxicity.toxicity(docs, model), 5, 0).select("doc_id", "held_out", "score", "predicted")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, share=80)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.planted(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_token_counts, op3_packing, op4_language, op5_ngram_jaccard, op6_exact_dedup, op7_substring_dedup, op8_mixing, op9_toxicity, op10_fingerprints, op11_minhash, op12_hard_negatives, op13_periodic_runs)
}
ORACLES: dict[str, str] = {"op5_ngram_jaccard": jaccard.SQL, "op6_exact_dedup": exact_dedup.SQL, "op7_substring_dedup": substring_dedup.SQL, "op11_minhash": minhash.SQL, "op12_hard_negatives": negatives.SQL}
