"""Positions in a total order, without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import own_name, stash

#: Positions that one row is exploded into at a time.
CHUNK = 1 << 16


def ordinals(rows: DataFrame, by: str, name: str = "ordinal", buckets: int | None = None) -> DataFrame:
    """rows with their place, from 0, in the order of an integer column.

    Rows are dealt by ranges of the column, whose bounds are drawn from its values, and numbered within theirs; the
    ranges' counts (one row a range) are summed up. Nulls come last.
    """
    part, at, first, n = (own_name(c, rows) for c in ("part", "at", "first", "n"))
    order = F.asc_nulls_last(by)
    ranged = rows.repartitionByRange(buckets, order) if buckets else rows.repartitionByRange(order)
    ranged = stash(ranged.withColumn(part, F.spark_partition_id()), "ranges")  # numbers of partitions stay as they are
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(n)).select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    placed = ranged.withColumn(at, F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1).join(F.broadcast(sizes), part)
    return placed.withColumn(name, F.col(first) + F.col(at)).drop(part, first, at)


def positions(items: DataFrame, item: str = "item") -> DataFrame:
    """pos (from 1) and item of all items in the order of their code points, repeated ones repeated; nulls come last.

    Items are counted first, so that what is ordered is the distinct items. These are dealt by ranges, whose bounds are
    drawn from the items, and summed up within theirs; the ranges' sums (one row a range) are summed up too. An item's
    positions are dealt out in chunks, so that a frequent item isn't one task's work.
    """
    by = F.asc_nulls_last("item")
    counts = items.groupBy(F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    ranged = stash(counts.repartitionByRange(by).withColumn("part", F.spark_partition_id()), "item-ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(parts), "part")
    start = F.col("first") + F.col("own") + 1
    chunks = placed.select("item", (start + F.col("n") - 1).alias("last"), F.explode(F.sequence(start, start + F.col("n") - 1, F.lit(CHUNK))).alias("start"))
    end = F.least(F.col("start") + CHUNK - 1, "last")
    return chunks.repartition("start").select(F.explode(F.sequence("start", end)).alias("pos"), "item")
