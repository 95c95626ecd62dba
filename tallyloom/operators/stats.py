"""How records spread over nodes and partitions: tasks to nodes, histograms, totals, localities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import partition_id
from .order import ordinals


def assign_nodes(tasks: DataFrame, nodes: int, task: str = "task") -> DataFrame:
    """Tasks dealt to nodes in turn, in the order of an integer task id: adds node."""
    return ordinals(tasks, task, "__ordinal").withColumn("node", (F.col("__ordinal") % nodes).cast("int")).drop("__ordinal")


def assign_named_nodes(tasks: DataFrame, nodes: int, task: str = "task") -> DataFrame:
    """The same for tasks with names (files of a directory): the names are listed once and dealt in order."""
    names = tasks.select(task).distinct()
    dealt = names.withColumn("node", ((F.row_number().over(Window.orderBy(task)) - 1) % nodes).cast("int"))
    return tasks.join(dealt, task)


def combined(pairs: DataFrame, partitions: int, is_text: bool = True) -> DataFrame:
    """Records counted by node and key, with the key's partition: node, pid, key, n. pairs: node, key."""
    counts = pairs.groupBy("node", "key").agg(F.count(F.lit(1)).alias("n"))
    keyed = counts.groupBy("key").agg(F.collect_list(F.struct("node", "n")).alias("on"))  # one entry a node, so that a key's bytes are summed once
    keyed = keyed.select("key", partition_id(F.col("key"), partitions, is_text).alias("pid"), F.explode("on").alias("on"))
    return keyed.select("on.node", "pid", "key", "on.n")


def grid(df: DataFrame, nodes: int, partitions: int) -> DataFrame:
    """All cells: node, pid."""
    cells = df.sparkSession.range(nodes * partitions)
    return cells.select(F.expr(f"cast(id div {partitions} as int)").alias("node"), (F.col("id") % partitions).cast("int").alias("pid"))


def matrix(combined_: DataFrame, nodes: int, partitions: int) -> DataFrame:
    """Records by node and partition, 0 where there are none: node, pid, n."""
    found = combined_.groupBy("node", "pid").agg(F.sum("n").alias("n"))
    cells = grid(combined_, nodes, partitions)
    return cells.join(found, ["node", "pid"], "left").select("node", "pid", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def totals(cells: DataFrame) -> DataFrame:
    """Totals of nodes (pid null), of partitions (node null) and of all (both null)."""
    return cells.groupingSets([["node"], ["pid"], []], "node", "pid").agg(F.sum("n").alias("n")).select("node", "pid", "n")


def share(n: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(n, total), F.lit(0.0))


def locality(cells: DataFrame) -> DataFrame:
    """node, pid, n, total (of the partition), internal (share of the node's records), node_loc (share of the
    partition's) and combined, their product. Empty nodes and partitions have 0."""
    total = F.sum("n").over(Window.partitionBy("pid"))
    internal, node_loc = share(F.col("n"), F.sum("n").over(Window.partitionBy("node"))), share(F.col("n"), total)
    return cells.select("node", "pid", "n", total.alias("total"), internal.alias("internal"), node_loc.alias("node_loc"), (internal * node_loc).alias("combined"))
