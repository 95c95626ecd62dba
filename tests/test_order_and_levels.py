"""As-of and interval joins, roll-up lattices and event-time streams against brute force."""

import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import intervals, lattice
from tallyloom.streaming import windows

T0 = datetime(2024, 1, 1)
AT = lambda s: None if s is None else T0 + timedelta(seconds=s)


def timed(spark, rows):
    """(key, seconds, id) with columns whose names clash with those of the joins."""
    return spark.createDataFrame([(k, AT(s), i, "x", 1, 1) for k, s, i in rows], "k string, t timestamp, id int, `right` string, part int, tag int")


def brute_as_of(left, right, strict=False, within=None):
    out = Counter()
    for k, s, i in left:
        some = [(t, j) for c, t, j in right if None not in (k, s, t) and c == k and (t < s if strict else t <= s)]
        t, j = max(some, default=(None, None))
        out[i, j if t is not None and (within is None or s - t <= within) else None] += 1
    return out


@pytest.mark.parametrize("strict,within,parts", [(False, None, 6), (True, None, 6), (False, 20, 3), (False, None, None)])
def test_as_of(spark, strict, within, parts):
    rng = random.Random(1)
    keys = ["hot"] * 8 + ["a", "b", "C", None]  # one key has most rows, so that it lies in several parts
    draw = lambda n, first: [(rng.choice(keys), rng.choice([None, *range(400)] if rng.random() < 0.1 else range(400)), first + i) for i in range(n)]
    left, right = draw(150, 0), draw(60, 1000)
    left += left[:5] + [("alone", 5, 900)]
    right += [("hot", 0, 2000), ("hot", 0, 2001), ("other", 3, 2002)]
    found = intervals.as_of(timed(spark, left), timed(spark, right), "t", ["k"], strict, within and within * 1_000_000, parts)
    assert Counter(map(tuple, found.select("left.id", F.col("right.id").alias("j")).collect())) == brute_as_of(left, right, strict, within)


def test_as_of_carries_over_many_parts(spark):
    left, right = [("hot", s, s) for s in range(10, 300)], [("hot", 1, 1), ("zzz", 0, 2)]
    found = intervals.as_of(timed(spark, left), timed(spark, right), "t", ["k"], parts=20)
    assert {r.j for r in found.select(F.col("right.id").alias("j")).collect()} == {1} and found.count() == 290


def test_as_of_of_empty_sides_and_without_keys(spark):
    some = [("a", 1, 1), ("b", 5, 2)]
    assert [r.right for r in intervals.as_of(timed(spark, some), timed(spark, []), "t", ["k"]).collect()] == [None, None]
    assert intervals.as_of(timed(spark, []), timed(spark, some), "t", ["k"]).count() == 0
    found = intervals.as_of(timed(spark, [("x", 3, 7)]), timed(spark, some), "t", [])
    assert found.select("right.id").first()[0] == 1


def spans(spark, rows):
    return spark.createDataFrame([(k, s, e, i, "x", 1, 1) for k, s, e, i in rows], "k string, start long, end long, id int, bucket string, level int, s int")


@pytest.mark.parametrize("by,most", [(["k"], 10_000), ([], 10_000), (["k"], 3), ([], 5)])
def test_overlapping(spark, by, most):
    rng = random.Random(2)

    def draw(n, first):
        rows = []
        for i in range(n):
            s = rng.randrange(-500, 500)
            rows.append((rng.choice(["hot"] * 6 + ["a", None]), s, s + rng.choice([0, 1, 2, 3, 8, 9, 64, 200, 2000, -3]), first + i))
        return rows

    left, right = draw(90, 0) + [("hot", None, 5, 900), ("hot", -(2**40), 2**40, 901)], draw(120, 1000) + [("hot", 0, 10, 2000)] * 3
    got = Counter(map(tuple, intervals.overlapping(spans(spark, left), spans(spark, right), by, bucket_rows=most).select("left.id", F.col("right.id").alias("j")).collect()))
    want = Counter()
    for k, s, e, i in left:
        for c, t, u, j in right:
            if None not in (s, t) and s < e and t < u and s < u and t < e and (not by or k is not None and k == c):
                want[i, j] += 1
    assert got == want and len(want) > 100


def test_overlapping_has_no_nested_loop(spark):
    df = spans(spark, [("a", 1, 5, 1), ("a", 2, 900, 2)])
    plan = intervals.overlapping(df, df, [])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.overlapping(df.limit(0), df, ["k"]).count() == 0


ROWS = [("a", 1, 5, "x"), ("a", 1, 7, "x"), ("a", 2, None, "y"), (None, 1, 3, "x"), (None, None, 2, None), ("b", None, 9, "z"), ("b", None, 9, "z")]


@pytest.mark.parametrize("sets", [lattice.cube(["g", "h"]), lattice.rollup(["g", "h"]), [("h",), ("g", "h")]])
@pytest.mark.parametrize("distinct", [{}, {"values": "v"}, {"values": "v", "tags": "w"}])
def test_levels(spark, sets, distinct):
    df = spark.createDataFrame(ROWS, "g string, h int, v int, w string")
    measures = {"n": ("count", None), "known": ("count", F.col("v")), "total": ("sum", F.col("v")), "least": ("min", F.col("v"))}
    got = lattice.aggregate_levels(df, sets, measures, {k: F.col(c) for k, c in distinct.items()})
    keys = list(dict.fromkeys(k for s in sets for k in s))
    want = Counter()
    for s in sets:
        level = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        groups = {}
        for row in (dict(zip("ghvw", r)) for r in ROWS):
            groups.setdefault(tuple(row[k] if k in s else None for k in keys), []).append(row)
        for key, rows in groups.items():
            v = [r["v"] for r in rows if r["v"] is not None]
            want[(*key, level, len(rows), len(v), sum(v) if v else None, min(v, default=None), *(len({r[c] for r in rows if r[c] is not None}) for c in distinct.values()))] += 1
    assert Counter(map(tuple, got.select(*keys, "level", *measures, *distinct).collect())) == want
    assert lattice.aggregate_levels(df.limit(0), sets, measures).count() == 0


EVENTS = "k string, t timestamp, n int"


def arrive(spark, path, rows):
    spark.createDataFrame([(k, AT(s), n) for k, s, n in rows], EVENTS).coalesce(1).write.mode("append").parquet(path)


def given_out(sink, spark, result):
    return Counter((r.start.replace(tzinfo=None), r.k, r.n) for r in sink.read(spark, result.schema).collect())


def test_windows_survive_a_killed_run(spark, tmp_path):
    """Killed behind each of two batches' writes and started again, the sink has each window once."""
    rng = random.Random(3)
    rows = sorted((rng.randrange(0, 3600), rng.choice("ab"), i) for i in range(200))
    for k in range(4):
        arrive(spark, f"{tmp_path}/in", [(c, s, n) for s, c, n in rows[k * 50 : (k + 1) * 50]])
    arrive(spark, f"{tmp_path}/in", [(None, 90_000, None), (None, None, 4)])
    schema = spark.read.parquet(f"{tmp_path}/in").schema

    def result():
        return windows.tumbling(windows.parquet_stream(spark, f"{tmp_path}/in", schema, 1), "t", "5 minutes", ["k"], [F.count("n").alias("n")], "1 minute")

    sink = windows.BatchSink(f"{tmp_path}/out")
    for dies in (1, 2):

        def after(batch, dies=dies):
            if batch == dies:
                raise RuntimeError("killed")

        with pytest.raises(Exception, match="killed"):
            windows.start(result(), sink, f"{tmp_path}/checkpoint", after).awaitTermination()
    windows.start(result(), sink, f"{tmp_path}/checkpoint").awaitTermination()
    want = Counter((s // 300 * 300, c) for s, c, _ in rows)
    assert given_out(sink, spark, result()) == Counter((AT(s), c, n) for (s, c), n in want.items())


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    for rows in ([("a", 10, 1), ("a", 4000, 1)], [("a", 3980, 1)], [("a", 20, 1), ("a", 3990, 1)], [("a", 90_000, 1)]):
        arrive(spark, f"{tmp_path}/in", rows)
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    result = windows.tumbling(windows.parquet_stream(spark, f"{tmp_path}/in", schema, 1), "t", "5 minutes", ["k"], [F.count("n").alias("n")], "1 minute")
    sink = windows.BatchSink(f"{tmp_path}/out")
    query = windows.start(result, sink, f"{tmp_path}/checkpoint")
    query.awaitTermination()
    assert windows.late_rows(query) == 1
    assert given_out(sink, spark, result) == Counter({(AT(0), "a", 1): 1, (AT(3900), "a", 3): 1})


def test_sessions(spark, tmp_path):
    df = spark.createDataFrame([("a", AT(0), 1), ("a", AT(50), 1), ("b", AT(55), 1), ("a", AT(140), 1), ("a", AT(300), 1)], EVENTS)
    schema = windows.replay(df, "t", f"{tmp_path}/in", 3, "1 day")
    result = windows.sessions(windows.parquet_stream(spark, f"{tmp_path}/in", schema, 1), "t", "100 seconds", ["k"], [F.count("n").alias("n")], "10 seconds")
    sink = windows.BatchSink(f"{tmp_path}/out")
    windows.start(result, sink, f"{tmp_path}/checkpoint").awaitTermination()
    assert given_out(sink, spark, result) == Counter({(AT(0), "a", 3): 1, (AT(55), "b", 1): 1, (AT(300), "a", 1): 1})


@pytest.mark.parametrize("query", ["stream_tumbling_windows", "stream_sessions"])
def test_replayed_step_whose_files_are_out_of_order(spark, tmp_path, monkeypatch, query):
    from tallyloom import queries

    rows = [(i, T0 + timedelta(minutes=7 * i), i % 3, "view", 1.0) for i in range(3000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(queries, "scratch_root", lambda _: f"file://{tmp_path}")
    start, seen, several = windows.start, set(), []

    def reversed_files(*args):
        steps = {}
        for f in sorted(tmp_path.glob("stream-*/events/part-*"), key=lambda f: (f.stat().st_mtime_ns, f.name)):
            if f not in seen:
                steps.setdefault(f.name[11:47], []).append(f)  # files of one write
        for files in steps.values():
            seen.update(files)
            several.append(len(files))
            ends = sorted(f.stat().st_mtime_ns // 1_000_000 for f in files)
            order = sorted(files, key=lambda f: f.name, reverse=True)
            for k, f in enumerate(order):
                os.utime(f, ns=((ends[0] + k) * 1_000_000,) * 2)
        return start(*args)

    monkeypatch.setattr(windows, "start", reversed_files)
    for k, v in ("maxPartitionBytes", "1000"), ("openCostInBytes", "1"):
        spark.conf.set(f"spark.sql.files.{k}", v)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = getattr(queries, query)(spark, str(tmp_path)).agg(F.sum("n"), F.sum("cents"), F.count(F.lit(1))).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(several) > 2
    assert tuple(got) == (3000, 300000, len({7 * i // 60 for i in range(3000)}) if query == "stream_tumbling_windows" else 3)


def test_levels_have_no_shuffle_of_values_by_set(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 1, 6)], "x string, y int, v int")
    got = lattice.aggregate_levels(df, lattice.cube(["x", "y"]), {"n": ("count", None)}, {"vs": F.col("v")})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan  # its output counts as dealt anew
    assert {(r.x, r.y, r.level, r.n, r.vs) for r in got.collect()} == {("a", 1, 0, 1, 1), ("a", 2, 0, 1, 1), ("b", 1, 0, 1, 1), ("a", None, 1, 2, 1), ("b", None, 1, 1, 1), (None, 1, 2, 2, 2), (None, 2, 2, 1, 1), (None, None, 3, 3, 2)}


def test_filed_intervals_carry_their_bounds_once(spark):
    left = spark.range(40).select("id", F.lit(0).cast("long").alias("start"), F.expr("shiftleft(1L, cast(id as int))").alias("end"))
    right = spark.range(1).select("id", F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("end"))
    joined = intervals.overlapping(left, right, [])
    assert joined.count() == 40
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "s2#" not in plan
