"""Job records: a table of timings, appended as JSON, and its tab-separated export."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TIMES = T.ArrayType(T.DoubleType())
RECORD = T.StructType(
    [
        T.StructField("job", T.StringType()),
        T.StructField("plan", T.StringType()),
        T.StructField("map_s", _TIMES),
        T.StructField("plan_s", _TIMES),
        T.StructField("reduce_s", _TIMES),
        T.StructField("job_s", T.DoubleType()),
        T.StructField("partitions", T.IntegerType()),
        T.StructField("nodes", T.IntegerType()),
        T.StructField("volume", T.IntegerType()),
        T.StructField("phases", T.ArrayType(T.StructType([T.StructField("phase", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("bytes", T.LongType())]))),
    ]
)


def append(spark: SparkSession, path: str, **values) -> str:
    """Adds a record with an id of its own, so that jobs of one second don't replace each other. Fields not given are null."""
    job = uuid.uuid4().hex
    row = tuple(job if f.name == "job" else values.get(f.name) for f in RECORD.fields)
    spark.createDataFrame([row], RECORD).coalesce(1).write.mode("append").json(path)
    return job


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def line() -> Column:
    """A record as one line: each field, the arrays' elements one by one, followed by a tab."""
    flat = lambda c: F.transform(c, lambda x: x.cast("string"))
    scalars = [F.col(c).cast("string") for c in ("plan", "nodes", "partitions", "volume")]
    return F.concat(F.concat_ws("\t", *scalars, flat("map_s"), flat("plan_s"), flat("reduce_s"), F.col("job_s").cast("string")), F.lit("\t"))


def export(records: DataFrame, path: str) -> None:
    records.select(line().alias("value")).write.mode("overwrite").text(path)
