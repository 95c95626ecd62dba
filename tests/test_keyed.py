"""The engine against DuckDB on the smallest tables, against Python models, and on edge cases."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom import queries
from tallyloom.__main__ import submit
from tallyloom.functions.text import byte_sum, ordinal, partition_id, split_words
from tallyloom.operators import aggregates, apps, engine, order, stats
from tallyloom.plans import benchmark, placement
from tallyloom.sources import records
from tallyloom.sources.text import items, text_column, text_directory
from tallyloom.streaming import counts

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "lineitem", "events", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def near(x):
    return round(x, 12) if isinstance(x, float) else x


def rows_of(names, rows):
    return Counter(tuple(near(r[names.index(n)]) for n in sorted(names)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"


@pytest.mark.parametrize("text", ["", "   ", "a", " a  b ", "x​y ﻿z", *(f"a{c}b{c}{c}c" for c in WHITE)])
def test_split_is_pythons(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(split_words(F.col("t"))).first()
    assert row[0] == text.split()


def test_null_text_has_no_items(spark):
    source = text_column(spark.createDataFrame([(1, None), (2, "a b")], "id long, t string"), "id", "t")
    assert [r["item"] for r in items(source).collect()] == ["a", "b"]


@pytest.mark.parametrize("key", ["", "the", "eht", "é", "日本", "𝄞x", "a" * 300])
def test_partition_is_byte_sum(spark, key):
    row = spark.createDataFrame([(key,)], "k string").select(byte_sum(F.col("k")), partition_id(F.col("k"), 100), partition_id(F.col("k"), 100, is_text=False)).first()
    assert tuple(row) == (sum(key.encode()), sum(key.encode()) % 100, 0)


def test_partitions_must_be_positive():
    with pytest.raises(ValueError):
        partition_id(None, 0)


def test_ordinals_and_positions(spark):
    df = spark.createDataFrame([(x,) for x in [5, -3, 900, 17, 5, None]], "id long")
    assert [r["ordinal"] for r in order.ordinals(df, "id").orderBy(F.asc_nulls_last("id")).collect()] == list(range(6))
    words = ["b", "a", "𝄞", "é", "ab", "a", "", "zz", "za"]
    df = spark.createDataFrame([(w,) for w in words], "item string")
    assert [r["item"] for r in order.positions(df).orderBy("pos").collect()] == sorted(words)
    empty = spark.createDataFrame([], "item string")
    assert order.positions(empty).collect() == [] and order.ordinals(spark.createDataFrame([], "id long"), "id").collect() == []


def test_ordinal_labels(spark):
    got = [r[0] for r in spark.range(1, 23).select(ordinal(F.col("id"))).collect()]
    assert got[:4] == ["1st", "2nd", "3rd", "4th"] and got[10] == "11th" and got[20:] == ["21th", "22th"]


def test_unknown_names():
    with pytest.raises(ValueError):
        apps.application("none")
    with pytest.raises(ValueError):
        placement.plan_name("none")
    assert placement.plan_name(None) == placement.CAPPED and placement.plan_name("HADOOP") == placement.MODULO


def words_on_nodes(spark, texts, nodes):
    tasks = text_column(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t")
    return items(stats.assign_nodes(tasks, nodes), "node")


@pytest.mark.parametrize("nodes,partitions", [(1, 5), (4, 2), (16, 100)])
def test_results_do_not_depend_on_nodes_or_partitions(spark, nodes, partitions):
    texts = ["the cat the eht", "a b a é 日本", "", "the end"]
    job = engine.Job("word_count", partitions, nodes)
    rows = words_on_nodes(spark, texts, nodes)
    want = Counter(w for t in texts for w in t.split())
    once = {r["key"]: (r["pid"], r["value"]) for r in engine.run(job, rows).collect()}
    twice = {r["key"]: (r["pid"], r["value"]) for r in engine.final_reduce(job, engine.local_combine(job, rows)).collect()}
    assert once == twice == {w: (sum(w.encode()) % partitions, n) for w, n in want.items()}


def test_results_of_nodes_are_merged_by_their_own_aggregate(spark):
    rows = words_on_nodes(spark, ["a b a", "a", "b a"], 2)
    count = apps.Application("count", key=lambda x: x, value=lambda x: F.lit(1), reduce=F.count, merge=F.sum)
    job = engine.Job(count, 3, 2)
    assert {r["key"]: r["value"] for r in engine.final_reduce(job, engine.local_combine(job, rows)).collect()} == {"a": 4, "b": 2}
    mean = engine.Job(apps.Application("mean", key=lambda x: x, value=lambda x: F.lit(1), value_type="double", reduce=F.avg), 3, 2)
    with pytest.raises(ValueError, match="merge"):
        engine.final_reduce(mean, engine.local_combine(mean, rows))


def test_ordinals_with_an_outlying_id(spark):
    df = spark.createDataFrame([(x, "y") for x in [*range(500), 2**62, -(2**62), None]], "id long, part string")
    got = order.ordinals(df, "id")
    assert got.columns == ["id", "part", "ordinal"]
    assert [r["ordinal"] for r in got.orderBy(F.asc_nulls_last("id")).collect()] == list(range(503))


def cells_of(spark, counts, nodes, partitions):
    rows = [(n, p, c) for (n, p), c in counts.items()]
    df = spark.createDataFrame(rows, "node int, pid int, n long") if rows else spark.createDataFrame([], "node int, pid int, n long")
    return stats.matrix(df, nodes, partitions)


def greedy_capped(counts, nodes, partitions):
    n = lambda a, p: counts.get((a, p), 0)
    rows, cols = [sum(n(a, p) for p in range(partitions)) for a in range(nodes)], [sum(n(a, p) for a in range(nodes)) for p in range(partitions)]
    cl = lambda a, p: (n(a, p) / rows[a] if rows[a] else 0.0) * (n(a, p) / cols[p] if cols[p] else 0.0)
    mean, load, out = sum(rows) / nodes, [0] * nodes, {}
    while True:
        fit = [(-cl(a, p), a, p) for a in range(nodes) for p in range(partitions) if p not in out and load[a] + cols[p] <= mean + mean * 0.2]
        if not fit:
            return out
        _, a, p = min(fit)
        out[p] = a
        load[a] += cols[p]


@pytest.mark.parametrize("counts,nodes,partitions", [({(0, 0): 90, (1, 1): 5, (0, 2): 5, (1, 2): 1}, 2, 4), ({(a, p): (a * 7 + p * 13) % 11 for a in range(3) for p in range(9)}, 3, 9), ({}, 3, 2), ({(0, 0): 4}, 1, 1)])
def test_planners(spark, counts, nodes, partitions):
    cells = cells_of(spark, counts, nodes, partitions)
    capped = {r["pid"]: r["node"] for r in placement.place(cells, nodes, "ICPP").collect()}
    assert capped == greedy_capped(counts, nodes, partitions)
    for plan in (placement.MODULO, placement.HEAP):
        assert sorted(r["pid"] for r in placement.place(cells, nodes, plan).collect()) == list(range(partitions))
    everything = placement.place_all(cells, nodes, placement.CAPPED).collect()
    assert sorted(r["pid"] for r in everything) == list(range(partitions))
    assert {r["pid"] for r in everything if r["placed"]} == set(capped)
    moved = placement.shuffle_plan(cells, placement.place(cells, nodes, placement.HEAP)).collect()
    assert all(r["src"] != r["dst"] for r in moved)
    left = {r["plan"]: r["left_out"] for r in placement.quality(cells, nodes).collect()}
    assert left[placement.MODULO] == left[placement.HEAP] == 0
    assert (left[placement.CAPPED] or 0) == sum(c for (_, p), c in counts.items() if p not in capped)


def test_dominating_key_is_left_out_by_the_cap_and_kept_by_the_job(spark):
    cells = cells_of(spark, {(0, 0): 1000, (1, 1): 10, (2, 2): 10, (3, 3): 10}, 4, 4)
    assert 0 not in {r["pid"] for r in placement.place(cells, 4, placement.CAPPED).collect()}
    assert {(r["pid"], r["placed"]) for r in placement.place_all(cells, 4, placement.CAPPED).collect()} >= {(0, False), (1, True)}


def test_python_reducer_leaves_single_records_untouched(spark):
    def fail_on_single(a, b):
        return a[0], a[1] + b[1]

    app = apps.Application("join", key=lambda x: x, value=lambda x: F.lit("v"), value_type="string", reduce_fn=fail_on_single)
    rows = spark.createDataFrame([(w,) for w in "a b a a".split()], "item string")
    assert sorted(tuple(r) for r in engine.run(engine.Job(app, 3), rows).select("key", "value").collect()) == [("a", "vvv"), ("b", "v")]


def test_python_reducer_holds_few_keys(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "HELD", 3)
    app = apps.Application("longest", key=lambda x: F.substring(x, 1, 1), value=lambda x: x, value_type="string", reduce_fn=lambda a, b: max(a, b, key=lambda r: r[1] or ""))
    words = ["a", "ab", None, "b", "", "abc", "c", "cd", "d", None, "a"] * 7
    rows = spark.createDataFrame([(w,) for w in words], "item string").repartition(3)
    got = engine.run(engine.Job(app, 3), rows).select("key", "value").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", "abc"), ("b", "b"), ("c", "cd"), ("d", "d"), ("", ""), (None, None)], key=str)
    assert engine.run(engine.Job(app, 3), rows.limit(0)).collect() == []


def test_python_map_gives_any_number_of_records(spark):
    app = apps.Application("letters", key=None, value=None, map_fn=lambda x: [(c, len(x["w"])) for c in x["w"] or ""], reduce=F.max)
    rows = spark.createDataFrame([("ab",), ("abc",), ("",), (None,)], "w string").select(F.struct("w").alias("item"))
    assert sorted(tuple(r) for r in app.reduced(app.pairs(rows)).collect()) == [("a", 3), ("b", 3), ("c", 3)]
    assert app.pairs(rows.limit(0)).collect() == []


def test_positions_of_items_with_one_head(spark, monkeypatch):
    monkeypatch.setattr(order, "CHUNK", 5)
    words = sorted([f"http{i % 37}" for i in range(400)] + ["http"] * 23)
    got = order.positions(spark.createDataFrame([(w,) for w in words] + [(None,)], "item string"))
    assert [tuple(r) for r in got.orderBy("pos").collect()] == [(i + 1, w) for i, w in enumerate([*words, None])]


def test_text_directory_and_sink(spark, tmp_path):
    source = tmp_path / "in"
    (source / "sub").mkdir(parents=True)
    (source / "a.txt").write_bytes(b"the cat\rsat\r\non the\nmat")
    (source / "b.txt").write_text("")
    (source / "_hidden").write_text("no")
    (source / ".dot").write_text("no")
    (source / "sub" / "c.txt").write_text("no")
    lines = text_directory(spark, str(source))
    words = items(lines)
    job = engine.Job("word_count", 7, 2)
    out = str(tmp_path / "out")
    engine.write(job, engine.run(job, words), out)
    back = spark.read.parquet(out)
    assert {r["key"]: r["value"] for r in back.collect()} == Counter("the cat sat on the mat".split())
    with pytest.raises(Exception, match="(?i)exists"):
        engine.write(job, engine.run(job, words), out, overwrite=False)
    assert stats.assign_named_nodes(lines.select("task").distinct(), 2).count() == 1
    with pytest.raises(ValueError):
        text_directory(spark, str(tmp_path / "missing"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        text_directory(spark, str(tmp_path / "empty"))


def test_records_and_benchmark(spark, tmp_path):
    path = str(tmp_path / "records")
    found = benchmark.run(spark, "word_count", {1: lambda: words_on_nodes(spark, ["a b", "b"], 2)}, path, str(tmp_path / "out"), repetitions=2, nodes=2, partitions=4)
    assert found.count() == 6 and found.select("job").distinct().count() == 6
    records.export(found, str(tmp_path / "lines"))
    line = spark.read.text(str(tmp_path / "lines")).first()[0]
    assert line.endswith("\t") and len(line.split("\t")) == 4 + 3 + 1 + 1


def test_submitted_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("the cat the")
    (tmp_path / "in" / "b").write_text("cat sat")
    out, kept = str(tmp_path / "out"), str(tmp_path / "records")
    times = submit(spark, "word_count", str(tmp_path / "in"), out, "NEW", 3, 10, kept)
    assert set(times) == {"map", "plan", "reduce", "job"} and records.read(spark, kept).first()["plan"] == placement.HEAP
    assert {r["key"]: r["value"] for r in spark.read.parquet(out).collect()} == {"the": 2, "cat": 2, "sat": 1}
    assert spark.read.parquet(out + "-placement").count() == 10
    with pytest.raises(ValueError):
        submit(spark, "none", str(tmp_path / "in"), out)


def test_map_output(spark, tmp_path):
    job = engine.Job("word_count", 5, 2)
    engine.write_map_output(job, words_on_nodes(spark, ["b a a", "a"], 2), str(tmp_path / "map"))
    rows = spark.read.parquet(str(tmp_path / "map")).collect()
    assert sorted((r["node"], r["pid"], r["key"], r["value"]) for r in rows) == [(0, 2, "a", 1), (0, 2, "a", 1), (0, 3, "b", 1), (1, 2, "a", 1)]


def test_map_output_works_out_partitions_once_for_equal_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engine, "REPEATED", 7)
    seen = []
    monkeypatch.setattr(engine, "with_partition", lambda rows, job, f=engine.with_partition: (seen.append(rows.count()), f(rows, job))[1])
    engine.write_map_output(engine.Job("word_count", 5, 2), words_on_nodes(spark, ["a " * 20 + "b"], 1), str(tmp_path / "map"))
    assert seen == [2]
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "map")).collect()) == ["a"] * 20 + ["b"]


def test_streaming_counts(spark, tmp_path):
    source = tmp_path / "stream"
    source.mkdir()
    (source / "1.txt").write_text("a b a")
    stream = counts.running(apps.word_count, counts.text_stream(spark, str(source), 1))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    (source / "2.txt").write_text("b c")
    query.processAllAvailable()
    query.stop()
    assert {r["key"]: r["value"] for r in spark.sql("SELECT * FROM running").collect()} == {"a": 2, "b": 2, "c": 1}
    with pytest.raises(ValueError):
        counts.running(apps.ordered, counts.text_stream(spark, str(source)))


def test_map_function_is_asked_once_for_equal_items(spark):
    from itertools import count

    calls = count()
    app = apps.Application("calls", key=None, value=None, map_fn=lambda w: [(w, next(calls)), (w, 0)] if w != "b" else [], reduce=F.max)
    rows = app.pairs(spark.createDataFrame([(w, i) for i, w in enumerate(["a", "b", None, "a", "c"] * 100)], "item string, t int").coalesce(1), "t")
    got = rows.collect()
    assert len(got) == 800 and max(r.value for r in got) == 2
    assert [(r.t, r.key) for r in got[:8]] == [(0, "a"), (0, "a"), (2, None), (2, None), (3, "a"), (3, "a"), (4, "c"), (4, "c")]
