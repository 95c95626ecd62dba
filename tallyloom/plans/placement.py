"""Placement of reduce partitions on nodes: three planners, their shuffles and loads, as DataFrames.

The planners see the node x partition matrix alone, whose size is set by the configuration and not by the data. The
two greedy ones choose step by step, which no window expresses, so they run over that matrix in one group.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stats import grid, locality

MODULO, CAPPED, HEAP = "modulo", "locality_capped", "load_heap"
#: Spellings of the plans' names that submissions may use.
ALIASES = {"HADOOP": MODULO, "ICPP": CAPPED, "NEW": HEAP}
DEFAULT = CAPPED
SLACK = 0.20
PLACED = "pid int, node int, step int, locality double"


def plan_name(name: str | None) -> str:
    """A plan's own name; an unknown one is a ValueError, none is the default."""
    name = ALIASES.get(name or DEFAULT, name or DEFAULT)
    if name not in PLANNERS:
        raise ValueError(f"no plan {name!r}; there are {', '.join(PLANNERS)}")
    return name


def modulo(cells: DataFrame, nodes: int) -> DataFrame:
    """Partition p on node p % nodes, whatever the records."""
    return cells.select("pid").distinct().select("pid", (F.col("pid") % nodes).cast("int").alias("node"), F.col("pid").alias("step"), F.lit(0.0).alias("locality"))


def _in_one_group(cells: DataFrame, choose) -> DataFrame:
    scored = locality(cells).select("node", "pid", "n", "total", "combined").withColumn("one", F.lit(1))
    return scored.groupBy("one").applyInPandas(lambda pdf: choose(pdf.drop(columns="one")), PLACED)


def locality_capped(cells: DataFrame, nodes: int, slack: float = SLACK) -> DataFrame:
    """Again and again the free cell of greatest combined locality whose node would stay within the mean load and
    `slack` more; ties go to the lowest node, then partition. A partition that fits nowhere is left out."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        mean = pdf["n"].sum() / nodes
        most = mean + mean * slack
        queue = sorted(zip(-pdf["combined"], pdf["node"], pdf["pid"], pdf["total"]))
        load, placed = dict.fromkeys(range(nodes), 0), {}
        # loads only grow, so a cell that doesn't fit now never will: one pass in order is the same as searching again
        for score, node, pid, total in queue:
            if pid not in placed and load[node] + total <= most:
                load[node] += total
                placed[pid] = (pid, node, len(placed) + 1, -score)
        return pd.DataFrame(list(placed.values()), columns=["pid", "node", "step", "locality"])

    return _in_one_group(cells, choose)


def load_heap(cells: DataFrame, nodes: int, by_total: bool = False) -> DataFrame:
    """In turn the node of least load takes its free partition of greatest combined locality; ties go to the lowest
    number. A node's load grows by `nodes` times its own records of the partition, or, with by_total, by all of the
    partition's records."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        wishes: dict = {node: [] for node in range(nodes)}
        for score, node, pid, n, total in zip(-pdf["combined"], pdf["node"], pdf["pid"], pdf["n"], pdf["total"]):
            wishes[node].append((score, pid, n, total))
        for own in wishes.values():
            own.sort(reverse=True)
        loads = [(0, node) for node in range(nodes)]
        free, rows = set(pdf["pid"]), []
        while free:
            load, node = heapq.heappop(loads)
            score, pid, n, total = wishes[node].pop()
            while pid not in free:
                score, pid, n, total = wishes[node].pop()
            free.remove(pid)
            rows.append((pid, node, len(rows) + 1, -score))
            heapq.heappush(loads, (load + (total if by_total else nodes * n), node))
        return pd.DataFrame(rows, columns=["pid", "node", "step", "locality"])

    return _in_one_group(cells, choose)


PLANNERS = {MODULO: modulo, CAPPED: locality_capped, HEAP: load_heap}


def place(cells: DataFrame, nodes: int, plan: str | None = None) -> DataFrame:
    """pid, node, step, locality by the plan of that name. cells: node, pid, n."""
    return PLANNERS[plan_name(plan)](cells, nodes)


def place_all(cells: DataFrame, nodes: int, plan: str | None = None) -> DataFrame:
    """As place, but a partition that the plan leaves out goes to the node that its records make least loaded, so that
    a job loses nothing: pid, node, placed (false for those)."""
    chosen = place(cells, nodes, plan)
    sized = cells.groupBy("pid").agg(F.sum("n").alias("total")).join(chosen, "pid", "left").withColumn("one", F.lit(1))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        load = dict.fromkeys(range(nodes), 0)
        for node, total in zip(pdf["node"], pdf["total"]):
            if not pd.isna(node):
                load[int(node)] += total
        rows = []
        for pid, node, total in sorted(zip(pdf["pid"], pdf["node"], pdf["total"]), key=lambda r: (-r[2], r[0])):
            placed = not pd.isna(node)
            node = int(node) if placed else min(load, key=lambda k: (load[k], k))
            if not placed:
                load[node] += total
            rows.append((pid, node, placed))
        return pd.DataFrame(rows, columns=["pid", "node", "placed"])

    return sized.groupBy("one").applyInPandas(fill, "pid int, node int, placed boolean")


def task_lists(placed: DataFrame, plan: str) -> DataFrame:
    """The order in which each node reduces its partitions: node, seq (from 1), pid. By partition, or for the heap by
    the locality they were taken for, greatest first, earlier steps before later ones."""
    order = [F.desc("locality"), "step"] if plan_name(plan) == HEAP else ["pid"]
    return placed.select("node", F.row_number().over(Window.partitionBy("node").orderBy(*order)).cast("long").alias("seq"), "pid")


def shuffle_plan(cells: DataFrame, placed: DataFrame) -> DataFrame:
    """What moves: every other node's records of a partition go to its node. pid, src, dst, n."""
    to = placed.select("pid", F.col("node").alias("dst"))
    return cells.join(F.broadcast(to), "pid").where("node <> dst").select("pid", F.col("node").alias("src"), "dst", "n")


def loads(cells: DataFrame, nodes: int, plans: tuple[str, ...] = (MODULO, CAPPED, HEAP)) -> DataFrame:
    """Records to reduce by plan and node, 0 for a node without a partition: plan, node, load."""
    sizes = cells.groupBy("pid").agg(F.sum("n").alias("total"))
    every = grid(cells, nodes, 1).select("node")
    out = None
    for plan in plans:
        own = place(cells, nodes, plan).join(sizes, "pid").groupBy("node").agg(F.sum("total").alias("load"))
        own = every.join(own, "node", "left").select(F.lit(plan).alias("plan"), "node", F.coalesce("load", F.lit(0)).cast("long").alias("load"))
        out = own if out is None else out.unionByName(own)
    return out


def quality(cells: DataFrame, nodes: int, plans: tuple[str, ...] = (MODULO, CAPPED, HEAP)) -> DataFrame:
    """By plan: most_over_mean load, moved (share of the placed records that change nodes), left_out records."""
    total = cells.agg(F.sum("n").alias("all"))
    out = None
    for plan in plans:
        told = cells.join(place(cells, nodes, plan).select("pid", F.col("node").alias("dst")), "pid", "left")
        per = told.groupBy("dst").agg(F.sum("n").alias("load"), F.sum(F.when(F.col("node") != F.col("dst"), F.col("n")).otherwise(0)).alias("moved"))
        placed = F.col("dst").isNotNull()
        own = per.agg(F.max(F.when(placed, F.col("load"))).alias("most"), F.sum(F.when(placed, F.col("moved"))).alias("moved"), F.sum(F.when(placed, F.col("load"))).alias("kept"))
        own = own.join(F.broadcast(total)).select(F.lit(plan).alias("plan"), F.try_divide(F.col("most") * nodes, F.col("all")).alias("most_over_mean"), F.try_divide("moved", "kept").alias("moved"), (F.col("all") - F.coalesce("kept", F.lit(0))).alias("left_out"))
        out = own if out is None else out.unionByName(own)
    return out
