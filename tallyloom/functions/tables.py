"""A table function that merges stretches of time into sessions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import OrderingColumn, PartitioningColumn

OPS = {"sum": lambda a, b: a + b, "min": min, "max": max}


@dataclass
class Plan(AnalyzeResult):
    """What analyze() found out, for each task."""

    keys: list[str] = field(default_factory=list)
    gap: int = 0
    measures: list[tuple[str, str]] = field(default_factory=list)


class MergeStretches:
    """merge_stretches(TABLE(t), keys, start, stop, gap, measures): t's stretches of a key made one where less than `gap`
    lies between the end of all before and the next one's start.

    keys: names of columns, with commas between; start and stop: names of integer columns (start <= stop); gap: an integer
    above 0; measures: 'name operation' with commas between, of sum, min and max, over integer columns whose nulls
    don't count. Returns keys, start, stop and measures. Null keys are equal. Rows without a start or a stop are left out.
    The function asks for its partitions and their order itself, and holds one stretch at a time.
    """

    def __init__(self, plan: Plan) -> None:
        self.plan, self.open, self.at = plan, None, None

    @staticmethod
    def analyze(t: AnalyzeArgument, keys: AnalyzeArgument, start: AnalyzeArgument, stop: AnalyzeArgument, gap: AnalyzeArgument, measures: AnalyzeArgument) -> Plan:
        if not t.isTable:
            raise ValueError("the first argument must be a table")
        if any(x.value is None for x in (keys, start, stop, gap, measures)):
            raise ValueError("keys, start, stop, gap and measures must be constants")
        if gap.value <= 0:
            raise ValueError("the gap must be above 0")
        columns = {f.name: f.dataType for f in t.dataType}
        names = [k.strip() for k in keys.value.split(",") if k.strip()]
        told = [tuple(m.split()) for m in measures.value.split(",") if m.strip()]
        if not names or any(len(m) != 2 or m[1] not in OPS for m in told):
            raise ValueError("there must be a key, and measures must be written as 'name operation', with sum, min or max")
        for c in [*names, start.value, stop.value, *(m[0] for m in told)]:
            if c not in columns:
                raise ValueError(f"no column {c}")
        schema = StructType()
        for k in names:
            schema = schema.add(k, columns[k])
        for c in ("start", "stop", *(m[0] for m in told)):
            schema = schema.add(c, LongType())
        plan = Plan(schema=schema, partitionBy=[PartitioningColumn(f"`{k}`") for k in names], orderBy=[OrderingColumn(f"`{start.value}`"), OrderingColumn(f"`{stop.value}`")])
        plan.keys, plan.gap, plan.measures = names, gap.value, told
        return plan

    def eval(self, t, keys, start, stop, gap, measures):
        if self.at is None:
            names = list(t.__fields__)
            self.at = names.index(start), names.index(stop), [names.index(m) for m, _ in self.plan.measures]
        a, z, values = t[self.at[0]], t[self.at[1]], [t[i] for i in self.at[2]]
        if a is None or z is None:
            return
        own = self.open
        if own is None or a - own[1] >= self.plan.gap:
            if own is not None:
                yield self._row()
            self.open = [a, z, values, [t[k] for k in self.plan.keys]]
            return
        own[1] = max(own[1], z)
        own[2] = [y if x is None else x if y is None else OPS[op](x, y) for x, y, (_, op) in zip(own[2], values, self.plan.measures)]

    def terminate(self):
        if self.open is not None:
            yield self._row()

    def _row(self) -> tuple:
        a, z, values, keys = self.open
        return (*keys, a, z, *values)


def register(spark: SparkSession, name: str = "merge_stretches") -> None:
    """Makes the function one of SQL's."""
    spark.udtf.register(name, F.udtf(MergeStretches))


def sessions(rows: DataFrame, keys: list[str], time: str, gap: int, measures: dict[str, str], slot: int) -> DataFrame:
    """keys, start, stop and measures of each session: rows of a key with less than `gap` from one to the next.

    Rows of a time are merged by slots first, so that a frequent key is many tasks' work; what a key's second merge
    takes is at most slot // gap + 2 stretches a slot, however many rows it has. time: the name of an integer column.
    """
    if slot < gap:
        raise ValueError("a slot must not be shorter than the gap")
    merge = F.udtf(MergeStretches)
    told = F.lit(",".join(f"{name} {op}" for name, op in measures.items()))
    taken = {c.lower() for c in (*keys, time, *measures)}
    part = next(n for n in ("slot", "slot_", "slot__") if n not in taken)
    own = [F.col(f"`{c}`") for c in (*keys, time, *measures)]
    parts = rows.select(*own).where(F.col(f"`{time}`").isNotNull()).withColumn(part, F.expr(f"floor(`{time}` / {slot})"))
    first = merge(parts.asTable(), F.lit(",".join([*keys, part])), F.lit(time), F.lit(time), F.lit(gap), told).drop(part)
    return merge(first.asTable(), F.lit(",".join(keys)), F.lit("start"), F.lit("stop"), F.lit(gap), told)
