"""Jobs: source, application, partitions and placement in, key-sorted partitions out."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import partition_id
from ..sources import versions
from .apps import Application, application

#: Types whose equal values may differ (0.0 and -0.0, strings of a collation), or that can't be grouped by.
INEXACT = re.compile("float|double|map|variant|collate")
#: Records that one row is repeated to at a time.
REPEATED = 10_000


@dataclass(frozen=True)
class Job:
    app: Application | str
    partitions: int = 100
    nodes: int = 16
    plan: str | None = None

    @property
    def application(self) -> Application:
        return application(self.app) if isinstance(self.app, str) else self.app


def with_partition(records: DataFrame, job: Job) -> DataFrame:
    is_text = job.application.key_type == "string"
    return records.withColumn("pid", partition_id(F.col("key"), job.partitions, is_text))


def run(job: Job, items: DataFrame) -> DataFrame:
    """pid, key, value: one record a key. Spark combines on the map side, and the partition id is worked out once a key.

    The plan decides on nodes, never on results (see plans.placement.place_all), so it isn't looked at here.
    """
    app = job.application
    return with_partition(app.reduced(app.pairs(items)), job).select("pid", "key", "value")


def local_combine(job: Job, items: DataFrame) -> DataFrame:
    """What each node would send: node, pid, key, value. items: node, item."""
    app = job.application
    return with_partition(app.reduced(app.pairs(items, "node"), "node"), job).select("node", "pid", "key", "value")


def final_reduce(job: Job, combined: DataFrame) -> DataFrame:
    """The nodes' records of a key made one: pid, key, value."""
    return job.application.merged(combined.select("pid", "key", "value"), "pid").select("pid", "key", "value")


def in_order(records: DataFrame) -> DataFrame:
    """pid, pos (from 1, by key within the partition), key, value."""
    return records.select("pid", F.row_number().over(Window.partitionBy("pid").orderBy("key")).cast("long").alias("pos"), "key", "value")


def write(job: Job, records: DataFrame, path: str, overwrite: bool = True) -> None:
    """Directories partition_id=<p> of Parquet, each sorted by key. No global order."""
    rows = records.withColumnRenamed("pid", "partition_id").repartitionById(job.partitions, "partition_id").sortWithinPartitions("partition_id", "key")
    rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("partition_id").parquet(path)


def write_map_output(job: Job, items: DataFrame, path: str, overwrite: bool = True) -> None:
    """For inspection: the nodes' records before any combining, as node=<n>/pid=<p>, each sorted by key. items: node, item."""
    records = job.application.pairs(items, "node")
    if INEXACT.search(records.select("key", "value").schema.simpleString()):
        rows = with_partition(records, job).repartition("node", "pid")
    else:  # equal records are counted, so that they get their partition and are shuffled once, and are repeated where they are written
        found = with_partition(records.groupBy("node", "key", "value").agg(F.count(F.lit(1)).alias("times")), job).repartition("node", "pid")
        parts = found.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(REPEATED).cast("long"))))
        rows = parts.withColumn("again", F.explode(F.array_repeat(F.lit(True), F.least(F.lit(REPEATED), F.col("times") - F.col("from")).cast("int")))).select(*records.columns, "pid")
    rows.sortWithinPartitions("node", "pid", "key").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("node", "pid").parquet(path)


def publish(job: Job, items: DataFrame, path: str) -> tuple[int, list[tuple[str, int, int]]]:
    """Runs a job and makes its result the one that versions.read(path) gives, all at once; its number, and the phases.

    A phase is its name, its records, and the bytes of their keys: of all records that were mapped, and of those that were
    reduced. They are counted while the job runs, by the tasks that succeed. The manifest keeps
    them as notes, with the schema.
    """
    app = job.application
    size = F.sum(F.octet_length(F.col("key").cast("string"))) if app.key_type != "binary" else F.sum(F.octet_length("key"))
    measures = [F.count(F.lit(1)).alias("rows"), F.coalesce(size, F.lit(0)).alias("bytes")]
    seen = {phase: Observation(phase) for phase in ("map", "reduce")}
    mapped = app.pairs(items).observe(seen["map"], *measures)
    result = with_partition(app.reduced(mapped).observe(seen["reduce"], *measures), job).select("pid", "key", "value")
    phases = []

    def told(o: Observation) -> tuple[int, int]:
        try:
            return o.get["rows"], o.get["bytes"]
        except Py4JJavaError as e:
            if "AssertionError" not in str(e.java_exception):
                raise
            return 0, 0  # an input that Spark knows to be empty isn't run, so its observation has no row

    def written(folder: str) -> None:
        write(job, result, folder)
        phases.extend((phase, *told(o)) for phase, o in seen.items())
        notes["phases"] = phases

    notes: dict = {"schema": f"key {app.key_type}, value {app.value_type}, partition_id int"}
    return versions.publish(items.sparkSession, path, written, notes=notes), phases


def timed(job: Job, items: DataFrame, path: str, overwrite: bool = True) -> tuple[DataFrame, float]:
    """Runs and writes a job; what was written, read back, and the seconds it took."""
    began = time.time()
    write(job, run(job, items), path, overwrite)
    took = time.time() - began
    return items.sparkSession.read.parquet(path), took
