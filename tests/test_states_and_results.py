"""Aggregates with states, sketches, results by version and the phases' counts, against brute force."""

import json
import math
import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyloom.__main__ import submit
from tallyloom.operators import aggregates, apps, engine, sketches
from tallyloom.sources import records, versions
from tallyloom.sources.text import items

VALUES = [None, float("nan"), -0.0, 0.0, 1.5, 2.0, 7.0, -3.0]


def brute_median(rows):
    by = defaultdict(list)
    for *key, v, w in rows:
        by[tuple(key)].append((v, w))
    out = {}
    for key, found in by.items():
        some = sorted((v, w) for v, w in found if v is not None and not math.isnan(v) and w is not None and w > 0)
        total, running, median = sum(w for _, w in some), 0, None
        for v, w in some:
            running += w
            if 2 * running >= total:
                median = v
                break
        out[key] = (len(found), total, median)
    return out


@pytest.mark.parametrize("held,batch", [(100_000, 10_000), (3, 7), (40, 10)])
def test_weighted_median(spark, monkeypatch, held, batch):
    monkeypatch.setattr(aggregates, "HELD", held)
    rng = random.Random(held)
    keys = [("hot", 1)] * 12 + [("a", None), (None, 2), (None, None), ("hot", 2), ("", 1)]
    rows = [(*rng.choice(keys), rng.choice(VALUES), rng.choice([None, -1, 0, 1, 2, 5])) for _ in range(400)] + [("nulls", 1, None, 1)] * 3
    df = spark.createDataFrame(rows, "k string, `n.k` int, v double, r0 int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = aggregates.aggregate(df, ["k", "n.k"], [F.col("v"), F.col("r0").cast("long")], aggregates.WeightedMedian()).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len({r[:2] for r in rows}) and {tuple(r[:2]): tuple(r[2:]) for r in found} == brute_median(rows)


def test_float_keys_and_refused_ones(spark):
    rows = [(0.0, 1.0, 1), (-0.0, 2.0, 1), (float("nan"), 3.0, 1), (float("nan"), 5.0, 2), (None, 1.0, 1)]
    df = spark.createDataFrame(rows, "k double, v double, w bigint")
    of = lambda keys: aggregates.aggregate(df, keys, [F.col("v"), F.col("w")], aggregates.WeightedMedian())
    assert sorted((str(r.k), r.n, r.median) for r in of(["k"]).collect()) == [("0.0", 2, 1.0), ("None", 1, 1.0), ("nan", 2, 5.0)]
    assert of(["k"]).where("1 = 0").collect() == [] and aggregates.aggregate(df.limit(0), ["k"], [F.col("v"), F.col("w")], aggregates.WeightedMedian()).collect() == []
    with pytest.raises(ValueError):
        of([])
    with pytest.raises(ValueError):
        aggregates.aggregate(df.withColumnRenamed("k", "n"), ["n"], [F.col("v"), F.col("w")], aggregates.WeightedMedian())
    with pytest.raises(ValueError):
        aggregates.aggregate(df.withColumn("k", F.array("k")), ["k"], [F.col("v"), F.col("w")], aggregates.WeightedMedian())


def test_sketches_merge_to_those_of_all_rows(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else rng.choice(["a", None]), rng.randrange(3000) if i % 10 else None, rng.gauss(0, 1) if i % 7 else None) for i in range(30_000)] + [("none", None, None)]
    df = spark.createDataFrame(rows, "k string, u int, v double").repartition(6, "v")
    of = lambda rows: sketches.states(rows, ["k"], {"u": F.col("u")}, {"v": F.col("v")})
    first, second, none = of(df.where("v < 0 or v is null")), of(df.where("v >= 0")), of(df.limit(0))
    ranks = (0.05, 0.5, 0.99)
    for state in (of(df), sketches.merged([first, second, none], ["k"], ["u"], ["v"])):
        found = {r.k: r for r in sketches.estimates(state, ["k"], ["u"], ["v"], ranks).collect()}
        assert set(found) == {"hot", "a", None, "none"} and (found["none"].u, found["none"].v, found["none"].v_n) == (0, None, 0)
        for key in ("hot", "a", None):
            users = {u for k, u, _ in rows if k == key and u is not None}
            values = sorted(v for k, _, v in rows if k == key and v is not None)
            assert abs(found[key].u - len(users)) <= 0.05 * len(users) and found[key].v_n == len(values)
            for r, q in zip(ranks, found[key].v):
                assert abs(sum(v <= q for v in values) / len(values) - r) <= 0.02


def words(spark, text):
    return spark.createDataFrame([(w,) for w in text.split()], "item string")


def counted(df):
    return sorted((r.key, r.value) for r in df.select("key", "value").collect())


def test_results_change_all_at_once(spark, tmp_path):
    job, path = engine.Job("word_count", 5), str(tmp_path / "out")
    with pytest.raises(ValueError):
        versions.read(spark, path)
    number, phases = engine.publish(job, words(spark, "b a é a"), path)
    assert number == 1 and phases == [("map", 4, 5), ("reduce", 3, 4)]
    assert versions.manifest(spark, path, 1)["notes"]["phases"] == [list(p) for p in phases]

    def dies(folder):
        spark.range(5).write.parquet(folder)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        versions.publish(spark, path, dies)
    assert counted(versions.read(spark, path)) == [("a", 2), ("b", 1), ("é", 1)] and len(list((tmp_path / "out" / "data").iterdir())) == 1
    reader = versions.read(spark, path)
    for text in ("c", "d d"):
        engine.publish(job, words(spark, text), path)
        if text == "c":  # the version before is kept for those who read it
            assert counted(reader) == [("a", 2), ("b", 1), ("é", 1)]
    assert counted(versions.read(spark, path)) == [("d", 2)] and counted(versions.read(spark, path, 2)) == [("c", 1)] and versions.versions(spark, path) == [2, 3]
    with pytest.raises(ValueError):
        versions.read(spark, path, 1)


def test_half_written_data_without_a_manifest_is_not_read(spark, tmp_path):
    path = str(tmp_path / "out")
    versions.publish(spark, path, lambda folder: spark.range(3).write.parquet(folder))
    spark.range(9).write.parquet(f"{path}/data/left-by-a-killed-job")
    (tmp_path / "out" / "manifests" / "_staged").write_text("{")
    assert versions.read(spark, path).count() == 3 and versions.versions(spark, path) == [1]


def test_appends_and_conflicts(spark, tmp_path):
    path = str(tmp_path / "out")
    add = lambda n: versions.publish(spark, path, lambda folder: spark.range(n).write.parquet(folder), append=True)
    assert [add(2), add(3)] == [1, 2] and versions.read(spark, path).count() == 5

    def slow(folder):  # another job appends meanwhile
        add(10)
        spark.range(1).write.parquet(folder)

    assert versions.publish(spark, path, slow, append=True) == 4 and versions.read(spark, path).count() == 16
    with pytest.raises(versions.Conflict):
        versions.publish(spark, path, slow)
    assert versions.read(spark, path).count() == 26
    Path(f"{path}/manifests/{6:012d}.json").write_text(json.dumps({"folders": [], "notes": {}}))
    with pytest.raises(versions.Conflict):
        versions._rename(spark, f"{path}/manifests/{5:012d}.json", f"{path}/manifests/{6:012d}.json")


def test_published_empty_input_and_submitted_job(spark, tmp_path):
    path = str(tmp_path / "none")
    _, phases = engine.publish(engine.Job("word_count", 5), items(spark.createDataFrame([(None,), ("",)], "value string")), path)
    assert phases == [("map", 0, 0), ("reduce", 0, 0)] and versions.read(spark, path).collect() == []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_text("b a a\n")
    out, kept = str(tmp_path / "job"), str(tmp_path / "records")
    submit(spark, "word_count", str(tmp_path / "in"), out, "NEW", 3, 10, kept, publish=True)
    assert counted(versions.read(spark, out)) == [("a", 2), ("b", 1)]
    assert [tuple(p) for p in records.read(spark, kept).first().phases] == [("map", 3, 3), ("reduce", 2, 2)]
    with pytest.raises(ValueError):
        submit(spark, "word_count", str(tmp_path / "in"), out, "NEW", 3, 10, overwrite=False, publish=True)
    assert apps.applications()


def test_states_are_bounded_by_their_bytes(spark, monkeypatch):
    df = spark.range(30_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 30_011).cast("double").alias("v"), (F.col("id") % 5).alias("w"))
    of = lambda: sorted(map(tuple, aggregates.aggregate(df, ["k"], [F.col("v"), F.col("w")], aggregates.WeightedMedian()).collect()))
    whole = of()
    monkeypatch.setattr(aggregates, "HELD_BYTES", 20_000)
    assert of() == whole and len(whole) == 3
