"""Applications: what makes a key and a value of an item, and how values of a key become one."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .aggregates import Fold, aggregate, one


#: Rows and bytes from which a map function gets its batches.
ROWS, BYTES = 200_000, 4 << 20


def larger(batches):
    """Batches put together to about so many rows or bytes, so that more of their items are equal."""
    held, rows, size, most, most_bytes = [], 0, 0, ROWS, BYTES
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= most or size >= most_bytes:
            yield one(held)
            held, rows, size = [], 0, 0
    if held:
        yield one(held)


@dataclass(frozen=True)
class Application:
    """key and value are columns over an item; where columns can't express them, `map_fn` is a Python function of an item
    (a struct is a dict) that gives any number of records (key, value), and key and value are None; it is asked once for
    equal items of some batches, so its records must depend on the item alone. Either `reduce` is an aggregate of the column "value" (native, combined
    map-side), or `reduce_fn` a Python function of two records (key, value) that gives one of the same key; it must be
    associative, and a key with a single record keeps it untouched. Neither: records stay as they are (ordered).
    `merge` is the aggregate that makes one of the results of `reduce` (F.sum for F.count); sum, min and max merge their
    own results, and an aggregate without a merge (an average) can't be combined by node first."""

    name: str
    key: Callable[[Column], Column] | None
    value: Callable[[Column], Column] | None
    value_type: str = "bigint"
    key_type: str = "string"
    reduce: Callable[[Column], Column] | None = None
    merge: Callable[[Column], Column] | None = None
    reduce_fn: Callable[[tuple, tuple], tuple] | None = None
    map_fn: Callable[[object], Iterable[tuple]] | None = None

    @property
    def schema(self) -> str:
        return f"key {self.key_type}, value {self.value_type}"

    def pairs(self, source: DataFrame, *keep: str, item: str = "item") -> DataFrame:
        """One record for each item, or as many as map_fn gives."""
        if self.map_fn is not None:
            return self._mapped(source, *keep, item=item)
        made = F.col(item)
        return source.select(*keep, self.key(made).cast(self.key_type).alias("key"), self.value(made).cast(self.value_type).alias("value"))

    def _mapped(self, source: DataFrame, *keep: str, item: str) -> DataFrame:
        fn = self.map_fn
        rows = source.select(*keep, F.col(item).alias("item"))
        schema = rows.select(*keep, F.lit(None).cast(self.key_type).alias("key"), F.lit(None).cast(self.value_type).alias("value")).schema
        arrow = to_arrow_schema(schema)
        flat = isinstance(rows.schema["item"].dataType, T.StringType | T.BinaryType | T.IntegralType)

        def records(batches):
            for batch in larger(batches):
                *kept, items = batch.columns
                if flat:
                    items = items.dictionary_encode(null_encoding="encode")
                    of_row, items = items.indices.to_numpy(zero_copy_only=False), items.dictionary
                else:
                    of_row = np.arange(batch.num_rows)
                found = [list(fn(item)) for item in items.to_pylist()]
                made = [record for some in found for record in some]
                if not made:
                    continue
                n = np.fromiter(map(len, found), np.int64, len(found))
                # row r has the records of its item from first[item] on, counts[r] of them
                first, counts = np.cumsum(n) - n, n[of_row]
                at = np.repeat(first[of_row] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                keys, values = (pa.array(c, f.type).take(pa.array(at)) for c, f in zip(zip(*made), list(arrow)[-2:]))
                rows = pa.array(np.repeat(np.arange(batch.num_rows), counts))
                yield pa.RecordBatch.from_arrays([*(c.take(rows).cast(f.type) for c, f in zip(kept, arrow)), keys, values], schema=arrow)

        return rows.mapInArrow(records, schema)

    def merged(self, partial: DataFrame, *keep: str) -> DataFrame:
        """One record for each key of what reduced() gave for parts of the records."""
        if self.reduce is None:
            return self.reduced(partial, *keep)
        merge = self.merge or (self.reduce if self.reduce in (F.sum, F.min, F.max) else None)
        if merge is None:
            raise ValueError(f"{self.name} has no merge, so its records can't be combined before they are reduced")
        return partial.groupBy(*keep, "key").agg(merge(F.col("value")).cast(self.value_type).alias("value"))

    def reduced(self, pairs: DataFrame, *keep: str) -> DataFrame:
        """One record for each key (and what is kept)."""
        if self.reduce is not None:
            return pairs.groupBy(*keep, "key").agg(self.reduce(F.col("value")).cast(self.value_type).alias("value"))
        if self.reduce_fn is None:
            return pairs.select(*keep, "key", "value")
        return aggregate(pairs, [*keep, "key"], [F.col("value")], Fold(self.reduce_fn, self.value_type))


_registry: dict[str, Application] = {}


def register(app: Application) -> Application:
    _registry[app.name] = app
    return app


def application(name: str) -> Application:
    if name not in _registry:
        raise ValueError(f"no application {name!r}; there are {', '.join(sorted(_registry))}")
    return _registry[name]


def applications() -> list[str]:
    return sorted(_registry)


word_count = register(Application("word_count", key=lambda x: x, value=lambda x: F.lit(1), reduce=F.sum))
ordered = register(Application("ordered_items", key=lambda x: x, value=lambda x: F.lit(1)))
