"""Results that change all at once: data goes to a folder of its own, and a manifest that names it makes it the result.

A path holds data/<id> folders and manifests/<number>.json. A manifest appears by one rename, when its data is whole;
readers follow the last one. So a job that dies while it writes leaves the old result as it was, and a reader never sees
a half-written or an empty one. Renames that don't replace are atomic on HDFS and local disks; a store whose renames are
copies needs a lock outside.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .scratch import remove

#: Results that stay readable for those who began to read before the last change.
KEPT = 2


class Conflict(Exception):
    """Another job changed the result first."""


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _rename(spark: SparkSession, source: str, to: str) -> None:
    """Atomic, and an error where `to` is there."""
    jvm, (target, fs) = spark.sparkContext._jvm, _hadoop(spark, to)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(_hadoop(spark, source)[0], target, none)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise Conflict(to) from e
        raise


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/manifests") if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    """folders (under data) and notes of a version."""
    p, fs = _hadoop(spark, f"{path}/manifests/{version:012d}.json")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, write: Callable[[str], None], append: bool = False, notes: dict | None = None, kept: int = KEPT) -> int:
    """Calls write(folder) and makes what it wrote the result at path, or adds it (append); the new version's number.

    Of two jobs that replace at once one gets a Conflict, and its data is removed; an append is tried again on top of the
    other's version. `notes`, which write may fill, go into the manifest. Folders that none of the last `kept` versions names are removed, but for those not yet named by any.
    """
    folder = uuid.uuid4().hex
    before = versions(spark, path)
    try:
        write(f"{path}/data/{folder}")
        while True:
            seen = versions(spark, path)
            if not append and seen != before:
                raise Conflict(path)
            old = manifest(spark, path, seen[-1])["folders"] if append and seen else []
            number = seen[-1] + 1 if seen else 1
            staged = f"{path}/manifests/_{folder}"
            p, fs = _hadoop(spark, staged)
            out = fs.create(p, True)
            out.write(json.dumps({"folders": [*old, folder], "notes": notes or {}}).encode())
            out.close()
            try:
                _rename(spark, staged, f"{path}/manifests/{number:012d}.json")
                break
            except Conflict:
                if not append:
                    raise
    except BaseException:
        remove(spark, f"{path}/data/{folder}")
        remove(spark, f"{path}/manifests/_{folder}")
        raise
    _forget(spark, path, kept)
    return number


def _forget(spark: SparkSession, path: str, kept: int) -> None:
    numbers = versions(spark, path)
    held = {f for n in numbers[-kept:] for f in manifest(spark, path, n)["folders"]}
    for n in numbers[:-kept]:
        for f in set(manifest(spark, path, n)["folders"]) - held:
            remove(spark, f"{path}/data/{f}")
        remove(spark, f"{path}/manifests/{n:012d}.json")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The result at path, or one of its versions that is still kept, with the columns of partition folders.

    Where the notes hold a schema (a DDL text), it is the result's, so that one without rows can be read too.
    """
    numbers = versions(spark, path)
    if not numbers or version is not None and version not in numbers:
        raise ValueError(f"no result {'' if version is None else version} in {path}")
    named = manifest(spark, path, version or numbers[-1])
    schema = named["notes"].get("schema")
    reader = spark.read.schema(schema) if schema else spark.read
    return reduce(DataFrame.unionByName, (reader.parquet(f"{path}/data/{f}") for f in named["folders"]))
