"""Aggregates by event time over a stream, with a watermark, and a sink that a replayed batch leaves as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType, TimestampNTZType

from ..functions.time import micros
from ..operators.order import ordinals
from ..sources.scratch import discard, own_name, stash


def parquet_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = 100) -> DataFrame:
    """Rows of the Parquet files that arrive in a directory, the oldest files first; None: a batch of all that has arrived."""
    stream = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(path)


def _held(events: DataFrame, time: str, lateness: str) -> DataFrame:
    """With a watermark; a time without a zone is taken as one of UTC."""
    if isinstance(events.schema[time].dataType, TimestampNTZType):
        events = events.withColumn(time, F.timestamp_micros(micros(events, time)))
    return events.withWatermark(time, lateness)


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], aggregates: list[Column], lateness: str) -> DataFrame:
    """start, end, keys and aggregates of each window of a width, once the watermark (the latest time less the lateness) has
    passed its end. Rows without a time are in no window; a row is late if its window has been given out, and left out."""
    held = _held(events, time, lateness)
    found = held.groupBy(F.window(time, width), *keys).agg(*aggregates)
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *(c for c in found.columns if c not in ("window", *keys)))


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], aggregates: list[Column], lateness: str) -> DataFrame:
    """start, end (the last time and the gap), keys and aggregates of each session: rows of a key with no gap between them."""
    held = _held(events, time, lateness)
    found = held.groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *(c for c in found.columns if c not in ("session_window", *keys)))


class BatchSink:
    """A folder of Parquet with a subfolder for each batch. A batch that runs again after a failure replaces its own
    subfolder, so every row is there once; readers see whole batches only, as a subfolder is named when it is whole."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, rows: DataFrame, batch: int) -> None:
        staged, final = f"{self.path}/_staged-{batch}", f"{self.path}/batch={batch}"
        rows.write.mode("overwrite").parquet(staged)
        jvm = rows.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(final).getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
        fs.delete(path(final), True)
        if not fs.rename(path(staged), path(final)):
            raise OSError(f"{staged} can't be renamed")

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.path}/batch=*")


def start(result: DataFrame, sink: BatchSink, checkpoint: str, after_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Runs over all that has arrived and ends; started again with the same checkpoint it goes on where it was."""

    def each(rows: DataFrame, batch: int) -> None:
        sink.write(rows, batch)
        if after_batch is not None:
            after_batch(batch)

    return result.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window had been given out, as far as the query's last progress reports tell."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p["stateOperators"])


def replay(rows: DataFrame, time: str, path: str, steps: int, closing: str, arrived: Callable[[], None] | None = None) -> StructType:
    """Writes rows as files of a stream, by time in so many steps, and a row far behind the last one, all null but for its
    time, that makes the watermark pass every window. Rows without a time come last. The schema of the stream.

    arrived is called after each step and after the last row. Tasks write a step's files at the same time, so that these
    aren't in order: a stream that takes a step's files in several batches finds some of its rows late.
    """
    us, at = own_name("us", rows), own_name("replayed", rows)
    placed = stash(ordinals(rows.withColumn(us, micros(rows, time)), us, at).drop(us), "replayed")
    total = placed.count()
    for k in range(steps):
        placed.where((F.col(at) >= k * total // steps) & (F.col(at) < (k + 1) * total // steps)).drop(at).write.mode("append").parquet(path)
        if arrived is not None:
            arrived()
    discard(placed)
    kind = rows.schema[time].dataType
    last = rows.agg(F.max(time).alias("last")).select((F.col("last") + F.expr(f"INTERVAL {closing}")).cast(kind).alias(time))
    last.select(*(F.col(time) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema)).write.mode("append").parquet(path)
    if arrived is not None:
        arrived()
    return rows.schema
