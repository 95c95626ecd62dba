"""Exact deduplication with a split for heavy hitters. DataFrame functions only.

Digests of the normalised texts are made once. A Misra-Gries summary (Spark's frequent-items sketch, mergeable,
of fixed size) names digests that may be frequent; those are counted exactly, and the verified ones, at most `top`,
are broadcast, so that their rows are resolved where they are read. The other digests, none of which can have more
than about rows / (0.75 * tracked) rows unless the top list is full, go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, own_name, stash, texts


def digest(text: Column) -> Column:
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256)


def summaries(docs: DataFrame, top: int, tracked: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id and text_sha256 of each row; text_sha256, keep_id, group_size of at most `top` frequent digests)."""
    digests = stash(texts(docs).select("doc_id", digest(F.col("text")).alias("text_sha256")), "digests")
    short = F.xxhash64("text_sha256")
    seen = digests.select(short.alias("short"))
    often = seen.agg(F.expr(f"approx_top_k(short, {top}, {tracked})").alias("t")).select(F.explode("t").alias("t")).select(F.col("t.item").alias("short"), F.col("t.count").alias("n"))
    often = F.broadcast(often.where("n > 1").select("short"))
    heavy = digests.withColumn("short", short).join(often, "short").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return digests, stash(heavy, "heavy")  # at most `top` rows, but for digests that share a short hash


def resolved(digests: DataFrame, heavy: DataFrame) -> DataFrame:
    told = digests.join(F.broadcast(heavy), "text_sha256", "left")
    is_heavy = F.col("group_size").isNotNull()
    same = Window.partitionBy("text_sha256").orderBy(F.desc_nulls_last("doc_id"))
    whole = Window.partitionBy("text_sha256")
    top_row = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    others = told.where(is_heavy & ~top_row).withColumn("kept", F.lit(False))
    winners = told.where(is_heavy & top_row).withColumn("kept", F.row_number().over(Window.partitionBy("text_sha256").orderBy("doc_id")) == 1)
    light = told.where(~is_heavy).withColumn("keep_id", F.max("doc_id").over(whole)).withColumn("group_size", F.count(F.lit(1)).over(whole)).withColumn("kept", F.row_number().over(same) == 1)
    return light.select(*out).unionByName(winners.select(*out)).unionByName(others.select(*out))


def exact_dedup(docs: DataFrame, top: int = 256, tracked: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z; null counts as empty, and empty texts are equal.
    Of equal texts the row with the largest doc_id stays. Repeated rows of that doc_id: one of them stays. A null
    doc_id stays only if its group has no other (then keep_id is null). No rows in, no rows out.
    """
    return resolved(*summaries(docs, top, tracked))


def deduplicated(docs: DataFrame, top: int = 256, tracked: int = 1024) -> DataFrame:
    """The rows of docs, with all their columns, that exact_dedup keeps; of rows that repeat doc_id and text one.

    Rows of frequent digests that don't stay are left out where they are read; the others are shuffled once.
    """
    digests, heavy = summaries(docs, top, tracked)
    sha, key, keep, size = (own_name(n, docs) for n in ("sha", "row", "keep_id", "group_size"))
    losers = F.broadcast(heavy.select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep), F.col("group_size").alias(size)))
    row = lambda digest_, doc_id: F.concat(digest_, F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    rows = docs.withColumn(sha, digest(F.col("text"))).join(losers, sha, "left")
    rows = rows.where(F.col(size).isNull() | F.col("doc_id").cast("long").eqNullSafe(F.col(keep)))
    rows = rows.withColumn(key, row(F.col(sha), F.col("doc_id").cast("long"))).select(key, *docs.columns)
    kept = resolved(digests, heavy).where("kept").select(row(F.col("text_sha256"), F.col("doc_id")).alias(key))
    return rows.join(kept, key, "left_semi").dropDuplicates([key]).select(docs.columns)


SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
