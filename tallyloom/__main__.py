"""python -m tallyloom APP INPUT OUTPUT [--plan P] [--nodes N] [--partitions P] [--records DIR]: one job over a text directory."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession

from .operators import apps, engine, stats
from .plans import placement
from .sources import records, versions
from .sources.text import items, text_directory

log = logging.getLogger("tallyloom")


def submit(spark: SparkSession, app: str, source: str, out: str, plan: str | None = None, nodes: int = 16, partitions: int = 100, record_dir: str | None = None, overwrite: bool = True, publish: bool = False) -> dict:
    """Runs a job, writes its result and, where asked for, its placement (out + "-placement") and a record of its times.

    With publish, `out` holds versions of the result (see sources.versions), and the record also tells the phases' records
    and bytes; a job that fails then leaves the old result.
    """
    plan = placement.plan_name(plan)
    job = engine.Job(apps.application(app), partitions, nodes, plan)
    if publish and not overwrite and versions.versions(spark, out):
        raise ValueError(f"there is a result in {out}")
    lines = text_directory(spark, source)
    began = time.time()
    rows = items(stats.assign_named_nodes(lines, nodes), "node")
    cells = stats.matrix(stats.combined(job.application.pairs(rows, "node"), partitions), nodes, partitions).persist()
    cells.count()
    mapped = time.time()
    placed = placement.place_all(cells, nodes, plan)
    placed.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{out.rstrip('/')}-placement")
    planned = time.time()
    if publish:
        _, phases = engine.publish(job, items(lines), out)
        took = time.time() - planned
    else:
        phases, (_, took) = None, engine.timed(job, items(lines), out, overwrite)
    cells.unpersist()
    cut = lambda t: int(t * 1000) / 1000
    times = {"map": cut(mapped - began), "plan": cut(planned - mapped), "reduce": cut(took), "job": cut(time.time() - began)}
    log.info("%s with plan %s took %s seconds", app, plan, times["job"])
    for phase, rows, size in phases or []:
        log.info("%s: %s records, %s bytes of keys", phase, rows, size)
    if record_dir:
        records.append(spark, record_dir, plan=plan, map_s=[times["map"]], plan_s=[times["plan"]], reduce_s=[times["reduce"]], job_s=times["job"], partitions=partitions, nodes=nodes, volume=0, phases=phases)
    return times


def main() -> None:
    p = argparse.ArgumentParser(prog="tallyloom", description=__doc__)
    p.add_argument("app", choices=apps.applications())
    p.add_argument("source")
    p.add_argument("out")
    p.add_argument("--plan", default=placement.DEFAULT)
    p.add_argument("--nodes", type=int, default=16)
    p.add_argument("--partitions", type=int, default=100)
    p.add_argument("--records")
    p.add_argument("--keep", action="store_true", help="fail if the output is there already")
    p.add_argument("--publish", action="store_true", help="change the output all at once, and keep the version before")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="[%(levelname)s] %(message)s")
    spark = SparkSession.builder.appName("tallyloom").getOrCreate()
    submit(spark, a.app, a.source, a.out, a.plan, a.nodes, a.partitions, a.records, overwrite=not a.keep, publish=a.publish)


if __name__ == "__main__":
    main()
