"""Roll-ups over several keys: the finest groups are made once, and coarser ones are merged from them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stash

#: How the states of a measure merge.
MERGES = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def cube(keys: list[str]) -> list[tuple[str, ...]]:
    """All subsets of the keys."""
    return [c for n in range(len(keys), -1, -1) for c in combinations(keys, n)]


def rollup(keys: list[str]) -> list[tuple[str, ...]]:
    """All beginnings of the keys."""
    return [tuple(keys[:n]) for n in range(len(keys), -1, -1)]


def aggregate_levels(rows: DataFrame, sets: list[tuple[str, ...]], measures: dict[str, tuple[str, Column | None]], distinct: dict[str, Column] | None = None) -> DataFrame:
    """One row for each group of each set of keys: keys (null where not in the set), level (grouping id: a bit for each key
    that is not in the set, the first key highest), measures, and counts of distinct values.

    measures: name -> (count, sum, min or max; column, None to count rows). distinct: name -> column whose distinct non-null
    values are counted. Null keys are groups of their own, told from left-out keys by level. The set () has a row if
    there are rows. Measures are summed up by all keys once, and the sets are merged from these sums. Distinct values are
    taken once by all keys, then dealt by value alone, so that each set's are told apart and counted where they lie: no
    set has a shuffle of its values. A value comes once for each group of all keys that has it.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    distinct = distinct or {}
    grouped = [F.col(f"`{k}`").alias(f"g{i}") for i, k in enumerate(keys)]
    start = {"count": lambda c: F.lit(1) if c is None else F.when(c.isNotNull(), 1).otherwise(0), "sum": lambda c: c, "min": lambda c: c, "max": lambda c: c}
    values = [start[kind](c).alias(f"m{i}") for i, (kind, c) in enumerate(measures.values())]
    by = [f"g{i}" for i in range(len(keys))]
    merge = [MERGES[kind](f"m{i}").alias(f"m{i}") for i, (kind, _) in enumerate(measures.values())]
    level_of = lambda s: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
    to_sets = F.explode(F.array(*(F.struct(*(F.when(F.lit(k in s), F.col(g)).alias(g) for k, g in zip(keys, by)), F.lit(level_of(s)).alias("level")) for s in sets))).alias("at")
    of_set = [*(F.col(f"at.{g}").alias(g) for g in by), F.col("at.level").alias("level")]
    finest = stash(rows.select(*grouped, *values, F.lit(0).alias("of")).groupBy(*by, "of").agg(*merge), "finest")
    held = [f"m{i}" for i in range(len(values))]
    out = finest.select(*held, to_sets).select(*of_set, *held).groupBy(*by, "level").agg(*merge)
    if distinct:
        marks = F.array(*(F.struct(F.lit(i).alias("of"), F.encode(c.cast("string"), "UTF-8").alias("v")) for i, c in enumerate(distinct.values())))
        seen = rows.select(*grouped, F.explode(marks).alias("mark")).where("mark.v is not null").select(*by, "mark.of", "mark.v").distinct()
        dealt = seen.repartition("of", "v")
        told = dealt.select("of", "v", to_sets).select(*of_set, "of", "v").distinct()
        counts = told.groupBy(*by, "level").agg(*(F.count_if(F.col("of") == i).alias(f"d{i}") for i in range(len(distinct))))
        out = out.unionByName(counts, allowMissingColumns=True).groupBy(*by, "level")
        out = out.agg(*merge, *(F.coalesce(F.sum(f"d{i}"), F.lit(0)).cast("long").alias(name) for i, name in enumerate(distinct)))
    named = [F.col(f"m{i}").alias(name) for i, name in enumerate(measures)]
    return out.select(*(F.col(g).alias(k) for g, k in zip(by, keys)), "level", *named, *distinct)
