"""A pipeline of the corpus operators over documents: toxicity, exact dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's result to the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup, jaccard, mixing, packing, toxicity
from tallyloom.llm.shared import fold, stash, table

#: Classification, sampling and packing can't be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity classifier predicts toxic."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    score = toxicity.score_column(spark, toxicity.fit(docs, labels))
    return docs.where(score(F.coalesce("text", F.lit(""))) < 0.5)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts keeps the one with the largest doc_id, and of repeated rows of that doc_id one."""
    return exact_dedup.deduplicated(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 of their five-word n-grams keeps one row.

    It is that with the smallest doc_id, a null one only if no other is there. Rows are told apart by doc_id and text.
    Rows that share a doc_id, or have none, are documents of their own: each stays or goes with its own group, and of
    several with the smallest doc_id, or of null ones alone, the one with the smallest hash stays. Of repeated rows of
    one doc_id and text one stays. Texts without words are linked with nothing, so that all of their rows stay.
    """
    return jaccard.rows_kept(docs, jaccard.components_kept(docs, width=5, share=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; texts stay whole, so one taken in part comes if half of it or more is taken."""
    mixed = mixing.mix(docs, F.array("source"))
    return mixing.repeated(docs, mixed)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", keep_clean),
    ("exact dedup", keep_one_copy),
    ("n-gram Jaccard join", keep_one_near_copy),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
