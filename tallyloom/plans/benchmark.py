"""A matrix of timed jobs: plans x sources x repetitions, each leaving a job record."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import engine, stats
from ..sources import records
from . import placement

log = logging.getLogger(__name__)


def run(spark: SparkSession, app: str, sources: dict[int, Callable[[], DataFrame]], record_path: str, out_path: str, plans=(placement.MODULO, placement.CAPPED, placement.HEAP), repetitions: int = 5, nodes: int = 16, partitions: int = 100) -> DataFrame:
    """Runs every job and returns the records. sources: by volume, a function that gives node and item rows.

    Spark gives no times by logical node, so a record's arrays have the job's one time each: the map side (matrix of
    the nodes' records), the placement, and the job.
    """
    for plan in plans:
        for volume, source in sources.items():
            for n in range(1, repetitions + 1):
                job = engine.Job(app, partitions, nodes, plan)
                began = time.time()
                rows = source()
                cells = stats.matrix(stats.combined(job.application.pairs(rows, "node"), partitions), nodes, partitions).persist()
                cells.count()
                mapped = time.time()
                placement.place_all(cells, nodes, plan).collect()  # one row a partition
                planned = time.time()
                _, took = engine.timed(job, rows, f"{out_path}/{plan}-{volume}-{n}")
                cells.unpersist()
                cut = lambda t: int(t * 1000) / 1000
                records.append(spark, record_path, plan=plan, map_s=[cut(mapped - began)], plan_s=[cut(planned - mapped)], reduce_s=[cut(took)], job_s=cut(time.time() - began), partitions=partitions, nodes=nodes, volume=volume)
                log.info("%s, volume %s, run %s: %.3f s", plan, volume, n, took)
    return records.read(spark, record_path)
