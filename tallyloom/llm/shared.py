"""What several corpus operators share: input columns, row keys, Arrow slices, crc folds."""

from __future__ import annotations

import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import BATCH, BATCH_BYTES, discard, own_name, setting, stash  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words are the longest runs of anything but these six characters.
SPACES = r"\x20\x09-\x0D"

def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone, so that other columns of the input can have any name; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of a row's doc_id and text, in hexadecimal; a null text is empty, a null doc_id differs from any other."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


#: What workers keep from task to task, by its operator. A worker may serve the tasks of all operators.
kept: dict[str, dict] = {}


def forget(owner: str = "") -> None:
    """Drops what this worker keeps for other operators than the owner."""
    for name, cache in kept.items():
        if name != owner:
            cache.clear()


def give_back() -> None:
    """Returns freed memory to the system, which a worker that waits for its next task would hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def slices(batches, most: int = 2_000_000, column: str = "text", owner: str = ""):
    """Arrow batches cut into runs of rows of about `most` bytes of text; a longer text is one run, whole."""
    forget(owner)
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(column))
        ends, start, total = [], 0, 0
        for i, n in enumerate(size.to_pylist()):
            total += n
            if total >= most:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
