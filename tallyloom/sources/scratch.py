"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FOLDER, CLEANUP = "spark.checkpoint.dir", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch that goes to a Python worker; a row is never divided. Executors hold several at a time.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)
_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; it is removed when the driver ends.

    Where the setting is missing, a session on one machine (master local) gets a temporary folder and the setting; on a
    cluster a folder of one machine would lose rows, so that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get(FOLDER, None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError(f"{FOLDER} must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
            spark.conf.set(FOLDER, base)
        _roots[app] = f"{base.rstrip('/')}/tallyloom-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _roots[app])
    return _roots[app]


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_removed(spark: SparkSession):
    """Within it, Spark removes a query's shuffle files as soon as the query ends."""
    return setting(spark, CLEANUP, "true")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder, where a lost executor doesn't lose it, and reads it back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    with shuffles_removed(spark), setting(spark, BATCH, BATCH_BYTES):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(*done: DataFrame) -> None:
    """Removes stashed tables that nothing will read again, once what was made of them is written."""
    for df in done:
        remove(df.sparkSession, df.stashed_at)


def own_name(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
