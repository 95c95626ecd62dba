"""Aggregates with a state of their own over Arrow columns: update, merge and finish work on all groups of a batch at once.

Each task sorts a batch by its keys, makes a state of each group and merges the states it holds when there are many.
The states are shuffled by key, and arrive sorted, so that a key's states are merged a batch at a time: no task holds a
key's rows, however many there are, and a key of half of all rows sends a state or a few from each task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: States that a task holds at a time, and their bytes, as a state may be large.
HELD, HELD_BYTES = 100_000, 8 << 20


@dataclass(frozen=True)
class Groups:
    """Rows in the order of their groups: group i is rows starts[i] to starts[i + 1] - 1, or to the end."""

    starts: np.ndarray
    keys: list[pa.Array]
    columns: list[pa.Array]

    @property
    def rows(self) -> int:
        return len(self.keys[0])

    @property
    def of_row(self) -> np.ndarray:
        """The group of each row."""
        return np.repeat(np.arange(len(self.starts)), np.diff(self.starts, append=self.rows))


class Aggregate:
    """state and result are lists of (name, type); each of the three gives one array a column, with one row a group.

    update gets the value columns, merge and finish the state's. merge must be associative, and the result must not depend
    on the order of a group's rows. finish gets one state a group.
    """

    state: list[tuple[str, str]]
    result: list[tuple[str, str]]

    def update(self, groups: Groups) -> list:
        raise NotImplementedError

    def merge(self, groups: Groups) -> list:
        raise NotImplementedError

    def finish(self, state: list[pa.Array]) -> list:
        return state


def changes(column: pa.Array) -> np.ndarray:
    """Whether a row's value isn't that of the row before; nulls are equal, and NaNs are."""
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    other = pc.fill_null(pc.not_equal(now, before), False)
    if pa.types.is_floating(column.type):
        other = pc.and_not(other, pc.fill_null(pc.and_(pc.is_nan(now), pc.is_nan(before)), False))
    return pc.or_(other, pc.xor(now.is_null(), before.is_null())).to_numpy(zero_copy_only=False)


def grouped(batch: pa.RecordBatch, n_keys: int) -> Groups:
    """Groups of a batch whose rows are sorted by its first n_keys columns."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in batch.columns[:n_keys]:
        new[1:] |= changes(k)
    return Groups(np.flatnonzero(new), batch.columns[:n_keys], batch.columns[n_keys:])


def in_key_order(batch: pa.RecordBatch, n_keys: int) -> pa.RecordBatch:
    return batch.take(pc.sort_indices(batch, sort_keys=[(n, "ascending") for n in batch.schema.names[:n_keys]]))


def one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def aggregate(df: DataFrame, keys: list[str], values: list[Column], agg: Aggregate) -> DataFrame:
    """The keys and the result's columns, one row a key; null keys are a group. No rows in, no rows out.

    Keys are atomic, and there is at least one; -0.0 and 0.0 are one key, and NaNs are.
    """
    names = [n for n, _ in agg.result]
    types = [df.schema[k].dataType for k in keys]
    if not keys or any(isinstance(t, T.ArrayType | T.StructType | T.MapType | T.VariantType) for t in types):
        raise ValueError(f"{keys} can't be keys: at least one, and atomic")
    if set(names) & set(keys):
        raise ValueError(f"results {names} have names of keys {keys}")
    n, held, held_bytes = len(keys), HELD, HELD_BYTES
    own = [f"k{i}" for i in range(n)]
    plain = lambda k, t: F.when(F.col(f"`{k}`") == 0, F.lit(0).cast(t)).otherwise(F.col(f"`{k}`")) if isinstance(t, T.FractionalType) else F.col(f"`{k}`")
    rows = df.select(*(plain(k, t).alias(o) for k, t, o in zip(keys, types, own)), *(v.alias(f"v{i}") for i, v in enumerate(values)))
    fields = [T.StructField(o, t) for o, t in zip(own, types)]
    named = lambda columns: T.StructType(fields + [T.StructField(c, T.DataType.fromDDL(t)) for c, t in columns])
    state, result = named([(f"s{i}", t) for i, (_, t) in enumerate(agg.state)]), named([(f"r{i}", t) for i, (_, t) in enumerate(agg.result)])
    state_arrow, result_arrow = to_arrow_schema(state), to_arrow_schema(result)

    def made(keys, columns, schema):
        arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip([*keys, *columns], schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def stated(batch, step):
        g = grouped(batch, n)
        at = pa.array(g.starts)
        return made([k.take(at) for k in g.keys], step(g), state_arrow)

    def by_task(batches):
        states, count, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                states.append(stated(in_key_order(batch, n), agg.update))
                count, size = count + states[-1].num_rows, size + states[-1].nbytes
            if count >= held or size >= held_bytes:
                states = [stated(in_key_order(one(states), n), agg.merge)]
                count, size = states[0].num_rows, states[0].nbytes
                if 2 * count >= held or 2 * size >= held_bytes:  # mostly keys, or values of states, that don't come again
                    yield states[0]
                    states, count, size = [], 0, 0
        if states:
            yield stated(in_key_order(one(states), n), agg.merge) if len(states) > 1 else states[0]

    def by_key(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = made(batch.columns[:n], batch.columns[n:], state_arrow)
            merged = stated(batch if last is None else one([last, batch]), agg.merge)
            last = merged.slice(merged.num_rows - 1)
            done = merged.slice(0, merged.num_rows - 1)
            if done.num_rows:
                yield made(done.columns[:n], agg.finish(done.columns[n:]), result_arrow)
        if last is not None:
            yield made(last.columns[:n], agg.finish(last.columns[n:]), result_arrow)

    partial = rows.mapInArrow(by_task, state).repartition(*own).sortWithinPartitions(*own)
    return partial.mapInArrow(by_key, result).toDF(*keys, *names)


class Fold(Aggregate):
    """A Python function of two records (key, value) that gives one of the same key; single records are kept as they are.

    The key is the last of the key columns.
    """

    def __init__(self, fn: Callable[[tuple, tuple], tuple], value_type: str):
        self.fn = fn
        self.state = self.result = [("value", value_type)]

    def update(self, groups: Groups) -> list:
        values, ends = groups.columns[0].to_pylist(), np.append(groups.starts[1:], groups.rows)
        keys = groups.keys[-1].take(pa.array(groups.starts)).to_pylist()
        fn = self.fn
        return [[reduce(lambda a, b: fn((k, a), (k, b))[1], values[i + 1 : j], values[i]) for k, i, j in zip(keys, groups.starts.tolist(), ends.tolist())]]

    merge = update


class WeightedMedian(Aggregate):
    """n: rows; weight: sum of the weights; median: the least value that half of the weight is at or below.

    Takes two value columns, a double and a bigint weight. Rows with a null, NaN or a weight below 1 count in n alone. The
    state is the distinct values of a key with their weights, so it is exact, and grows with these.
    """

    state = [("n", "bigint"), ("at", "array<double>"), ("weights", "array<bigint>")]
    result = [("n", "bigint"), ("weight", "bigint"), ("median", "double")]

    @staticmethod
    def _distinct(group: np.ndarray, value: np.ndarray, weight: np.ndarray, n_groups: int) -> tuple[pa.Array, pa.Array]:
        order = np.lexsort((value, group))
        group, value, weight = group[order], value[order], weight[order]
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        at = np.flatnonzero(new)
        sums = np.add.reduceat(weight, at) if len(at) else weight
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(group[at], minlength=n_groups))]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(value[at])), pa.ListArray.from_arrays(offsets, pa.array(sums))

    def update(self, groups: Groups) -> list:
        value = pc.fill_null(groups.columns[0].cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) + 0.0
        weight = pc.fill_null(groups.columns[1].cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
        whole = ~np.isnan(value) & (weight > 0)
        n = np.diff(groups.starts, append=groups.rows)
        return [n, *self._distinct(groups.of_row[whole], value[whole], weight[whole], len(groups.starts))]

    def merge(self, groups: Groups) -> list:
        n, at, weights = groups.columns
        of = groups.of_row[pc.list_parent_indices(at).to_numpy(zero_copy_only=False)]
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (at, weights)]
        return [np.add.reduceat(n.to_numpy(zero_copy_only=False), groups.starts), *self._distinct(of, *flat, len(groups.starts))]

    def finish(self, state: list[pa.Array]) -> list:
        n, at, weights = state
        size = pc.list_value_length(at).to_numpy(zero_copy_only=False)
        value, weight = (x.flatten().to_numpy(zero_copy_only=False) for x in (at, weights))
        total = np.concatenate([[0], np.cumsum(weight)])
        end = np.cumsum(size)
        low, whole = total[end - size], total[end] - total[end - size]
        found = np.searchsorted(total[1:], low + (whole + 1) // 2)  # the first whose running weight is half or more
        some = size > 0
        median = pa.array(value[np.where(some, found, 0)] if len(value) else np.zeros(len(size)), mask=~some)
        return [n, whole, median]
