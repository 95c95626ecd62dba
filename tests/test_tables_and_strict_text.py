"""The table function that merges stretches, and the strict text source, against brute force."""

import random

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallyloom.functions import tables
from tallyloom.sources import strict


def brute_stretches(rows, gap):
    """Stretches of a key joined one by one, whatever their order."""
    out = []
    for key in {r[0] for r in rows}:
        groups = []
        for _, a, z, v in sorted((r for r in rows if r[0] == key and r[1] is not None and r[2] is not None), key=lambda r: (r[1], r[2])):
            if groups and a - max(g[1] for g in groups[-1]) < gap:
                groups[-1].append((a, z, v))
            else:
                groups.append([(a, z, v)])
        for g in groups:
            some = [v for _, _, v in g if v is not None]
            out.append((key, g[0][0], max(z for _, z, _ in g), sum(some) if some else None, max(some) if some else None))
    return sorted(out, key=repr)


def test_merge_stretches_in_sql(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(500):
        a = rng.choice([None, *range(-200, 200)])
        rows.append((rng.choice(["hot", "hot", "hot", "a", None, ""]), a, None if a is None or rng.random() < 0.02 else a + rng.randrange(4), rng.choice([None, -3, 0, 5])))
    spark.createDataFrame(rows, "`k.k` string, first long, last int, v int").withColumn("w", F.col("v")).createOrReplaceTempView("stretches")
    tables.register(spark)
    got = spark.sql("SELECT * FROM merge_stretches(TABLE(stretches), 'k.k', 'first', 'last', 2, 'v sum, w max')")
    assert got.columns == ["k.k", "start", "stop", "v", "w"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_stretches(rows, 2)
    assert spark.sql("SELECT * FROM merge_stretches(TABLE(SELECT * FROM stretches WHERE first > 999), 'k.k', 'first', 'last', 2, '')").collect() == []


@pytest.mark.parametrize("args", ["'no', 'first', 'last', 2, ''", "'', 'first', 'last', 2, ''", "'k.k', 'first', 'last', 0, ''", "'k.k', 'first', 'last', 2, 'v avg'", "'k.k', 'first', 'last', 2, 'v'", "'k.k', 'first', 'last', 2, 'x sum'"])
def test_merge_stretches_refuses(spark, args):
    spark.createDataFrame([("a", 1, 2, 3)], "`k.k` string, first long, last long, v long").createOrReplaceTempView("stretches")
    tables.register(spark)
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM merge_stretches(TABLE(stretches), {args})").collect()


@pytest.mark.parametrize("slot", [5, 17, 10_000])
def test_sessions_by_slots(spark, slot):
    rng = random.Random(slot)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([1, None]), rng.choice([None, *range(-300, 300)]), 1) for _ in range(400)]
    df = spark.createDataFrame(rows, "slot string, k2 int, t long, n long").repartition(3)
    got = tables.sessions(df, ["slot", "k2"], "t", 5, {"n": "sum"}, slot)
    want = brute_stretches([((a, b), t, t, n) for a, b, t, n in rows], 5)
    assert sorted((((r[0], r[1]), *r[2:]) for r in map(tuple, got.collect())), key=repr) == sorted((w[:4] for w in want), key=repr)
    with pytest.raises(ValueError):
        tables.sessions(df, ["slot"], "t", 5, {"n": "sum"}, 4)


TEXTS = {
    "a.txt": "one\ntwo\r\n\nthrée 日本\n",
    "_named": "under\nscore",
    ".hidden": "﻿dot\n",
    "empty": "",
    "long": "x" * 50 + "\n" + "é" * 40 + "\nend\n",
}


def folder(tmp_path, texts=TEXTS):
    path = tmp_path / "in"
    path.mkdir()
    (path / "sub").mkdir()
    (path / "sub" / "unread").write_text("no")
    for name, t in texts.items():
        (path / name).write_bytes(t.encode())
    return path


def lines_of(texts):
    out = []
    for name, t in texts.items():
        at, data = 0, t.encode()
        for line in data.split(b"\n")[: -1 if data.endswith(b"\n") or not data else None]:
            out.append((name, at, line.removesuffix(b"\r").decode() if at + len(line) < len(data) else line.decode()))
            at += len(line) + 1
    return sorted(out)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 20])
def test_ranges_of_lines(spark, tmp_path, size):
    path = folder(tmp_path)
    spark.dataSource.register(strict.StrictText)
    got = spark.read.format("strict_text").option("range_bytes", size).load(str(path))
    assert got.columns == ["task", "position", "value"] and sorted(map(tuple, got.collect())) == lines_of(TEXTS)
    one = spark.read.format("strict_text").option("files", "[_.]*").load(path.as_uri())
    assert sorted(map(tuple, one.collect())) == lines_of({k: TEXTS[k] for k in ("_named", ".hidden")})


def test_blocks_smaller_than_lines(monkeypatch, tmp_path):
    monkeypatch.setattr(strict, "BLOCK", 3)
    path = str(folder(tmp_path))
    for size in (1, 5, 1000):
        parts = strict._Batch(path, "*", size).partitions()
        rows = pa.Table.from_batches([b for p in parts for b in strict._lines(path, p)]).to_pylist()
        assert sorted((r["task"], r["position"], r["value"]) for r in rows) == lines_of(TEXTS)
    assert [strict._ended(path, n, 0, len(t.encode())) for n, t in TEXTS.items()] == [len(t.encode()) if t.endswith("\n") else t.encode().rfind(b"\n") + 1 for t in TEXTS.values()]


def test_invalid_bytes_and_missing_input(spark, tmp_path):
    path = folder(tmp_path, {"good": "fine\n"})
    (path / "bad").write_bytes(b"ok\nsome \xc3\xa9 \xff here\n")
    spark.dataSource.register(strict.StrictText)
    load = lambda p, **o: spark.read.format("strict_text").options(**o).load(str(p)).collect()
    with pytest.raises(Exception, match="bad: byte 11 isn't UTF-8"):
        load(path)
    assert len(load(path, files="g*")) == 1
    for p, o in ((tmp_path / "none", {}), (path, {"files": "z*"}), (path, {"range_bytes": "0"})):
        with pytest.raises(Exception, match="no input directory|no files|range_bytes"):
            load(p, **o)
    (path / "void").write_bytes(b"")
    assert load(path, files="void") == []


def test_stream_of_growing_files(spark, tmp_path):
    """Lines are given out once, over restarts too; a last line waits for its end."""
    path, out = folder(tmp_path, {"a": "1\n2\n3", "b": ""}), str(tmp_path / "out")
    spark.dataSource.register(strict.StrictText)

    def step():
        stream = spark.readStream.format("strict_text").option("range_bytes", 2).load(str(path))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted((r.task, r.position, r.value) for r in spark.read.parquet(out).collect())

    assert step() == [("a", 0, "1"), ("a", 2, "2")]
    (path / "a").write_text("1\n2\n33\n4")
    (path / "_c").write_text("new\n")
    assert step() == [("_c", 0, "new"), ("a", 0, "1"), ("a", 2, "2"), ("a", 4, "33")]
    (path / "_c").unlink()
    assert len(step()) == 4
    (path / "a").write_text("1\n")
    with pytest.raises(Exception, match="bytes were read"):
        step()
