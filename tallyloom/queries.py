"""The engine's queries over the driver's tables and their SQL. Documents are map tasks, 16 nodes, 100 partitions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tables
from .functions.text import ordinal, partition_id, seconds
from .functions.time import micros
from .operators import aggregates, apps, engine, intervals, lattice, order, sketches, stats
from .plans import placement
from .sources import records, versions
from .sources.scratch import scratch_root, stash
from .sources.strict import StrictText
from .sources.text import items, text_column, text_directory
from .streaming import windows

NODES, PARTITIONS = 16, 100
JOB = engine.Job("word_count", PARTITIONS, NODES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(text_column(_table(spark, sf_dir, "documents"), "doc_id", "text"), "task")


def _on_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = text_column(_table(spark, sf_dir, "documents"), "doc_id", "text")
    nodes = stats.assign_nodes(tasks.select("task"), NODES)  # by ids alone, so that texts aren't sorted
    return items(tasks.join(nodes, "task"), "node")


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.local_combine(JOB, _on_nodes(spark, sf_dir)).select("node", "pid", F.col("key").alias("word"), F.col("value").alias("n"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.matrix(_combined(spark, sf_dir), NODES, PARTITIONS)


def word_count(spark, sf_dir):
    return engine.run(JOB, _words(spark, sf_dir)).select(F.col("key").alias("word"), F.col("value").alias("n"))


def tokenize(spark, sf_dir):
    return _words(spark, sf_dir).select(F.col("task").alias("doc_id"), F.col("item").alias("word"))


def map_pairs(spark, sf_dir):
    return JOB.application.pairs(_words(spark, sf_dir))


def key_partition(spark, sf_dir):
    words = _words(spark, sf_dir).select(F.col("item").alias("word")).distinct()
    return words.select("word", partition_id(F.col("word"), PARTITIONS).alias("pid"))


def local_combine(spark, sf_dir):
    return _combined(spark, sf_dir)


def combine_then_reduce(spark, sf_dir):
    combined = engine.local_combine(JOB, _on_nodes(spark, sf_dir))
    return engine.final_reduce(JOB, combined).select("pid", F.col("key").alias("word"), F.col("value").alias("n"))


def sorted_partition_output(spark, sf_dir):
    return engine.in_order(engine.run(JOB, _words(spark, sf_dir))).select("pid", "pos", F.col("key").alias("word"), F.col("value").alias("n"))


def partition_histogram(spark, sf_dir):
    return _cells(spark, sf_dir)


def node_partition_totals(spark, sf_dir):
    return stats.totals(_cells(spark, sf_dir))


def task_assignment(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return stats.assign_nodes(docs, NODES, "doc_id").select("doc_id", "node")


def locality(spark, sf_dir):
    return stats.locality(_cells(spark, sf_dir)).select("node", "pid", "internal", "node_loc", "combined")


def place_modulo(spark, sf_dir):
    return placement.place(_cells(spark, sf_dir), NODES, placement.MODULO).select("pid", "node")


def place_locality_capped(spark, sf_dir):
    return placement.place(_cells(spark, sf_dir), NODES, placement.CAPPED).select("pid", "node")


def place_load_heap(spark, sf_dir):
    return placement.place(_cells(spark, sf_dir), NODES, placement.HEAP)


def _shuffle(plan):
    def query(spark, sf_dir):
        cells = _cells(spark, sf_dir)
        return placement.shuffle_plan(cells, placement.place(cells, NODES, plan))

    return query


def load_report(spark, sf_dir):
    return placement.loads(_cells(spark, sf_dir), NODES)


def _task_lists(plan):
    def query(spark, sf_dir):
        return placement.task_lists(placement.place(_cells(spark, sf_dir), NODES, plan), plan)

    return query


def ordered_items(spark, sf_dir):
    return order.positions(_words(spark, sf_dir))


def sum_by_key(spark, sf_dir):
    app = apps.Application("sum_by_key", key=lambda x: x["l_returnflag"], value=lambda x: x["l_quantity"].cast("long"), reduce=F.sum)
    lines = _table(spark, sf_dir, "lineitem").select(F.struct("l_returnflag", "l_quantity").alias("item"))
    return engine.run(engine.Job(app, PARTITIONS, NODES), lines).select("key", F.col("value").alias("total"))


def python_reducer(spark, sf_dir):
    app = apps.Application("largest", key=lambda x: x["event_type"], value=lambda x: x["event_id"], reduce_fn=lambda a, b: a if a[1] >= b[1] else b)
    events = _table(spark, sf_dir, "events").select(F.struct("event_type", "event_id").alias("item"))
    return engine.run(engine.Job(app, PARTITIONS, NODES), events).select("key", F.col("value").alias("largest"))


def nonstring_key_partition(spark, sf_dir):
    keys = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    return keys.select("key", partition_id(F.col("key"), PARTITIONS, is_text=False).alias("pid"))


def python_map(spark, sf_dir):
    """Words by their length, with a map function in Python."""
    app = apps.Application("word_lengths", key=None, value=None, key_type="bigint", map_fn=lambda word: [(len(word), 1)], reduce=F.sum)
    return engine.run(engine.Job(app, PARTITIONS, NODES), _words(spark, sf_dir)).select("key", F.col("value").alias("n"))


def count_merged(spark, sf_dir):
    """A count by node first, merged by a sum."""
    app = apps.Application("count", key=lambda x: x, value=lambda x: F.lit(1), reduce=F.count, merge=F.sum)
    job = engine.Job(app, PARTITIONS, NODES)
    return engine.final_reduce(job, engine.local_combine(job, _on_nodes(spark, sf_dir))).select("pid", F.col("key").alias("word"), F.col("value").alias("n"))


def sink_round_trip(spark, sf_dir):
    """The word count written by partition, sorted by key, and read back."""
    path = f"{scratch_root(spark)}/sink-{uuid.uuid4().hex}"
    back, _ = engine.timed(JOB, _words(spark, sf_dir), path)
    return back.select(F.col("partition_id").cast("int").alias("pid"), F.col("key").alias("word"), F.col("value").alias("n"))


def map_output_round_trip(spark, sf_dir):
    """How many records each node's map output, written for 10 partitions and read back, holds by partition."""
    job = engine.Job("word_count", 10, NODES)
    path = f"{scratch_root(spark)}/map-{uuid.uuid4().hex}"
    engine.write_map_output(job, _on_nodes(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("node").cast("int").alias("node"), F.col("pid").cast("int").alias("pid")).agg(F.count(F.lit(1)).alias("n"))


def text_directory_count(spark, sf_dir):
    """Word count over a directory of text files, made of the documents' texts."""
    path = f"{scratch_root(spark)}/text-{uuid.uuid4().hex}"
    _table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    return engine.run(JOB, items(text_directory(spark, path))).select(F.col("key").alias("word"), F.col("value").alias("n"))


def record_round_trip(spark, sf_dir):
    """Export lines of job records written as JSON and read back."""
    path = f"{scratch_root(spark)}/records-{uuid.uuid4().hex}"
    _nation_records(spark, sf_dir).write.json(path)
    lines = f"{path}-lines"
    records.export(records.read(spark, path), lines)
    return spark.read.text(lines).select(F.col("value").alias("line"))


def placement_quality(spark, sf_dir):
    return placement.quality(_cells(spark, sf_dir), NODES)


def place_all_locality_capped(spark, sf_dir):
    return placement.place_all(_cells(spark, sf_dir), NODES, placement.CAPPED)


def ordinal_suffix(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("n"))
    return n.select("n", ordinal(F.col("n")).alias("label"))


def truncated_seconds(spark, sf_dir):
    ids = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") / 4096).alias("t"))
    return ids.select("event_id", seconds(F.col("t")).alias("s"))


def _nation_records(spark, sf_dir):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    return _table(spark, sf_dir, "nation").select(
        F.lit("").alias("job"), F.col("n_name").alias("plan"), F.array(n + F.lit(0.5), r + F.lit(0.25)).alias("map_s"), F.array(n + F.lit(1.5), r + F.lit(1.25)).alias("plan_s"),
        F.array(n + F.lit(2.5), r + F.lit(2.25)).alias("reduce_s"), (n + F.lit(3.5)).alias("job_s"), F.lit(PARTITIONS).alias("partitions"), F.lit(2).alias("nodes"), n.alias("volume"),
    )


def record_export(spark, sf_dir):
    return _nation_records(spark, sf_dir).select(records.line().alias("line"))


def _streamed(spark, sf_dir, over, closing):
    """The events replayed as a stream of files, each step one batch, and what was given out of it."""
    path, events = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}", _table(spark, sf_dir, "events")
    sink = windows.BatchSink(f"{path}/out")
    result = lambda: over(windows.parquet_stream(spark, f"{path}/events", events.schema, files_per_trigger=None))
    windows.replay(events, "ts", f"{path}/events", 4, closing, lambda: windows.start(result(), sink, f"{path}/checkpoint").awaitTermination())
    return sink.read(spark, result().schema)


def _measures():
    return [F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.max("event_id").alias("last_id")]


def stream_tumbling_windows(spark, sf_dir):
    """Events by hour and type, from a stream in order of time."""
    out = _streamed(spark, sf_dir, lambda events: windows.tumbling(events, "ts", "1 hour", ["event_type"], _measures(), "10 minutes"), "2 days")
    return out.select(micros(out, "start").alias("start_us"), "event_type", "n", "cents", "last_id")


def stream_sessions(spark, sf_dir):
    """Sessions of users, with 12 hours of silence between them, from a stream in order of time."""
    out = _streamed(spark, sf_dir, lambda events: windows.sessions(events, "ts", "12 hours", ["user_id"], _measures(), "10 minutes"), "4 days")
    return out.select(micros(out, "start").alias("start_us"), micros(out, "end").alias("end_us"), "user_id", "n", "cents", "last_id")


def as_of_join(spark, sf_dir):
    """Each purchase with the user's last view at or before it."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    found = intervals.as_of(events.where("event_type = 'purchase'"), events.where("event_type = 'view'"), "ts", ["user_id"])
    return found.select("left.event_id", F.col("right.event_id").alias("view_id"))


def interval_join(spark, sf_dir):
    """Errors, which last as many minutes as their value, and the purchases, of ten minutes each, that they overlap."""
    events = _table(spark, sf_dir, "events")
    events = events.withColumn("start", micros(events, "ts"))
    errors = events.where("event_type = 'error'").select("event_id", "start", (F.col("start") + (F.col("value") * 60_000_000).cast("long")).alias("end"))
    purchases = events.where("event_type = 'purchase'").select("event_id", "start", (F.col("start") + 600_000_000).alias("end"))
    return intervals.overlapping(errors, purchases, []).select(F.col("left.event_id").alias("error_id"), F.col("right.event_id").alias("purchase_id"))


def merged_sessions(spark, sf_dir):
    """The sessions of stream_sessions by a table function over the events at rest, a day's at a time first."""
    events = _table(spark, sf_dir, "events")
    rows = events.select("user_id", micros(events, "ts").alias("us"), F.lit(1).cast("long").alias("n"), F.round(F.col("value") * 100).cast("long").alias("cents"), F.col("event_id").alias("last_id"))
    found = tables.sessions(rows, ["user_id"], "us", 43_200_000_000, {"n": "sum", "cents": "sum", "last_id": "max"}, 86_400_000_000)
    return found.select(F.col("start").alias("start_us"), (F.col("stop") + 43_200_000_000).alias("end_us"), "user_id", "n", "cents", "last_id")


def _text_files(spark, sf_dir):
    path = f"{scratch_root(spark)}/text-{uuid.uuid4().hex}"
    _table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    spark.dataSource.register(StrictText)
    return path


def strict_text_count(spark, sf_dir):
    """Word count over text files of the documents' texts, by the source that takes no invalid byte, in ranges of 1 MB."""
    lines = spark.read.format("strict_text").option("files", "part-*").option("range_bytes", 1 << 20).load(_text_files(spark, sf_dir))
    return engine.run(JOB, items(lines)).select(F.col("key").alias("word"), F.col("value").alias("n"))


def stream_text_count(spark, sf_dir):
    """The same over the files as a stream: each batch's counts, written by batch, and their sum."""
    path = _text_files(spark, sf_dir)
    stream = spark.readStream.format("strict_text").option("files", "part-*").option("range_bytes", 1 << 20).load(path)
    sink = windows.BatchSink(f"{path}-counts")
    out = stream.writeStream.foreachBatch(lambda rows, batch: sink.write(engine.run(JOB, items(rows)), batch))
    out.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    counts = sink.read(spark, engine.run(JOB, _words(spark, sf_dir)).schema)
    return engine.final_reduce(JOB, counts).select(F.col("key").alias("word"), F.col("value").alias("n"))


def _levels(spark, sf_dir, sets):
    lines = _table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    measures = {"n": ("count", None), "quantity": ("sum", F.col("l_quantity").cast("long")), "dearest": ("max", F.col("l_extendedprice"))}
    return lattice.aggregate_levels(lines, sets, measures, {"suppliers": F.col("l_suppkey"), "parts": F.col("l_partkey")})


def cube_distinct(spark, sf_dir):
    """All subsets of three keys of lineitem, with counts of distinct suppliers and parts."""
    return _levels(spark, sf_dir, lattice.cube(["l_returnflag", "l_linestatus", "year"]))


def rollup_distinct(spark, sf_dir):
    return _levels(spark, sf_dir, lattice.rollup(["year", "l_returnflag", "l_linestatus"]))


def weighted_median(spark, sf_dir):
    """Lines, their summed quantity, and the price that half of the quantity was sold at or below, by return flag."""
    lines = _table(spark, sf_dir, "lineitem")
    return aggregates.aggregate(lines, ["l_returnflag"], [F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("long")], aggregates.WeightedMedian())


def published_word_count(spark, sf_dir):
    """The word count as the result that a manifest names."""
    path = f"{scratch_root(spark)}/published-{uuid.uuid4().hex}"
    engine.publish(JOB, _words(spark, sf_dir), path)
    return versions.read(spark, path).select(F.col("partition_id").cast("int").alias("pid"), F.col("key").alias("word"), F.col("value").alias("n"))


def job_metrics(spark, sf_dir):
    """Records and bytes of keys that the phases of a word count saw."""
    _, phases = engine.publish(JOB, _words(spark, sf_dir), f"{scratch_root(spark)}/measured-{uuid.uuid4().hex}")
    return spark.createDataFrame(phases, "phase string, rows long, bytes long")


def sketches_of_days(spark, sf_dir):
    """Sketches of each day's events, merged by type; whether they are within 5 % of the users and 2 % of the values' ranks."""
    events, ranks = _table(spark, sf_dir, "events"), (0.1, 0.25, 0.5, 0.75, 0.9)
    by_day = stash(sketches.states(events.withColumn("day", F.to_date("ts")), ["event_type", "day"], {"users": F.col("user_id")}, {"values": F.col("value")}), "days")
    merged = sketches.merged([by_day], ["event_type"], ["users"], ["values"])
    told = stash(sketches.estimates(merged, ["event_type"], ["users"], ["values"], ranks), "estimates")
    at = [F.col("values")[i] for i in range(len(ranks))]
    counts = [F.count(F.when(F.col("value") < q, 1)).alias(f"below{i}") for i, q in enumerate(at)] + [F.count(F.when(F.col("value") <= q, 1)).alias(f"upto{i}") for i, q in enumerate(at)]
    exact = events.join(told, "event_type").groupBy("event_type", "values_n", F.col("users").alias("told")).agg(F.countDistinct("user_id").alias("exact"), *counts)
    near = [(F.col(f"below{i}") <= (r + 0.02) * F.col("values_n")) & (F.col(f"upto{i}") >= (r - 0.02) * F.col("values_n")) for i, r in enumerate(ranks)]
    return exact.select("event_type", F.col("values_n").alias("n"), (F.abs(F.col("told") - F.col("exact")) <= 0.05 * F.col("exact")).alias("users_near"), F.array_min(F.array(*near)).alias("values_near"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        word_count, tokenize, map_pairs, key_partition, local_combine, combine_then_reduce, sorted_partition_output, partition_histogram, node_partition_totals, task_assignment, locality,
        place_modulo, place_locality_capped, place_load_heap, load_report, ordered_items, sum_by_key, python_reducer, nonstring_key_partition, ordinal_suffix, truncated_seconds, record_export,
        python_map, count_merged, sink_round_trip, map_output_round_trip, text_directory_count, record_round_trip, placement_quality, place_all_locality_capped,
        stream_tumbling_windows, stream_sessions, as_of_join, interval_join, cube_distinct, rollup_distinct, weighted_median, published_word_count, job_metrics, sketches_of_days,
        merged_sessions, strict_text_count, stream_text_count,
    )
} | {
    "shuffle_plan_modulo": _shuffle(placement.MODULO),
    "shuffle_plan_locality_capped": _shuffle(placement.CAPPED),
    "shuffle_plan_load_heap": _shuffle(placement.HEAP),
    "task_lists_modulo": _task_lists(placement.MODULO),
    "task_lists_locality_capped": _task_lists(placement.CAPPED),
    "task_lists_load_heap": _task_lists(placement.HEAP),
}

_BASE = r"""
d AS (SELECT doc_id, text, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 16 AS INTEGER) AS node FROM documents),
k AS (SELECT node, doc_id, unnest(regexp_split_to_array(text, '\s+')) AS word FROM d),
t AS (SELECT node, doc_id, word FROM k WHERE word <> ''),
wn AS (SELECT node, word, count(*) AS n FROM t GROUP BY ALL),
wp AS (SELECT node, word, n, CAST(list_sum(list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1)) % 100 AS INTEGER) AS pid FROM wn),
m AS (
  SELECT a.node, b.pid, CAST(coalesce(s.n, 0) AS BIGINT) AS n
  FROM (SELECT CAST(range AS INTEGER) AS node FROM range(16)) a CROSS JOIN (SELECT CAST(range AS INTEGER) AS pid FROM range(100)) b
  LEFT JOIN (SELECT node, pid, sum(n) AS n FROM wp GROUP BY ALL) s ON s.node = a.node AND s.pid = b.pid),
l AS (SELECT node, pid, n, CAST(sum(n) OVER (PARTITION BY pid) AS BIGINT) AS tot, (n / sum(n) OVER (PARTITION BY node)) * (n / sum(n) OVER (PARTITION BY pid)) AS cl FROM m)"""

_CAPPED = """,
cap AS (SELECT sum(n) / 16 + (sum(n) / 16) * CAST(0.20 AS DOUBLE) AS cap FROM m),
gc AS (
  SELECT 0 AS step, -1 AS pid, -1 AS node, CAST([] AS INTEGER[]) AS done, list_transform(range(16), lambda i: CAST(0 AS BIGINT)) AS loads
  UNION ALL
  SELECT step + 1, b.pid, b.node, list_append(done, b.pid), list_transform(loads, lambda x, i: CASE WHEN i = b.node + 1 THEN x + b.tot ELSE x END)
  FROM (
    SELECT gc.step, gc.done, gc.loads, min_by(struct_pack(pid := l.pid, node := l.node, tot := l.tot), row(-l.cl, l.node, l.pid)) AS b
    FROM gc, l, cap WHERE NOT list_contains(gc.done, l.pid) AND gc.loads[l.node + 1] + l.tot <= cap.cap GROUP BY ALL) z)"""

_HEAP = """,
gh AS (
  SELECT 0 AS step, -1 AS pid, -1 AS node, CAST(0 AS DOUBLE) AS locality, CAST([] AS INTEGER[]) AS done, list_transform(range(16), lambda i: CAST(0 AS BIGINT)) AS loads
  UNION ALL
  SELECT step + 1, b.pid, b.node, b.cl, list_append(done, b.pid), list_transform(loads, lambda x, i: CASE WHEN i = b.node + 1 THEN x + 16 * b.n ELSE x END)
  FROM (
    SELECT gh.step, gh.done, gh.loads, min_by(struct_pack(pid := l.pid, node := l.node, n := l.n, cl := l.cl), row(gh.loads[l.node + 1], l.node, -l.cl, l.pid)) AS b
    FROM gh, l WHERE NOT list_contains(gh.done, l.pid) GROUP BY ALL) z)"""

_MERGED = "(SELECT pid, word, CAST(sum(n) AS BIGINT) AS n FROM wp GROUP BY pid, word)"
_PLAIN, _GREEDY = "WITH" + _BASE, "WITH RECURSIVE" + _BASE


def _moves(placed: str) -> str:
    return f" SELECT m.pid, m.node AS src, g.node AS dst, m.n FROM m JOIN {placed} g ON g.pid = m.pid WHERE m.node <> g.node"


ORACLES: dict[str, str] = {
    "word_count": r"WITH k AS (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) SELECT word, count(*) AS n FROM k WHERE word <> '' GROUP BY word",
    "tokenize": _PLAIN + " SELECT doc_id, word FROM t",
    "map_pairs": _PLAIN + " SELECT word AS key, CAST(1 AS BIGINT) AS value FROM t",
    "key_partition": _PLAIN + " SELECT DISTINCT word, pid FROM wp",
    "local_combine": _PLAIN + " SELECT node, pid, word, n FROM wp",
    "combine_then_reduce": _PLAIN + f" SELECT pid, word, n FROM {_MERGED}",
    "sorted_partition_output": _PLAIN + f" SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY word) AS pos, word, n FROM {_MERGED}",
    "partition_histogram": _PLAIN + " SELECT node, pid, n FROM m",
    "node_partition_totals": _PLAIN + " SELECT node, pid, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY GROUPING SETS ((node), (pid), ())",
    "task_assignment": _PLAIN + " SELECT doc_id, node FROM d",
    "locality": _PLAIN + " SELECT node, pid, n / sum(n) OVER (PARTITION BY node) AS internal, n / sum(n) OVER (PARTITION BY pid) AS node_loc, cl AS combined FROM l",
    "place_modulo": _PLAIN + " SELECT DISTINCT pid, CAST(pid % 16 AS INTEGER) AS node FROM m",
    "place_locality_capped": _GREEDY + _CAPPED + " SELECT pid, node FROM gc WHERE step > 0",
    "place_load_heap": _GREEDY + _HEAP + " SELECT pid, node, step, locality FROM gh WHERE step > 0",
    "load_report": _GREEDY + _CAPPED + _HEAP + """,
asg AS (SELECT DISTINCT 'modulo' AS plan, pid, CAST(pid % 16 AS INTEGER) AS node FROM m UNION ALL SELECT 'locality_capped', pid, node FROM gc WHERE step > 0 UNION ALL SELECT 'load_heap', pid, node FROM gh WHERE step > 0),
own AS (SELECT asg.plan, asg.node, sum(p.n) AS load FROM asg JOIN (SELECT pid, sum(n) AS n FROM m GROUP BY pid) p ON p.pid = asg.pid GROUP BY asg.plan, asg.node)
SELECT p.plan, a.node, CAST(coalesce(own.load, 0) AS BIGINT) AS load
FROM (SELECT unnest(['modulo', 'locality_capped', 'load_heap']) AS plan) p CROSS JOIN (SELECT CAST(range AS INTEGER) AS node FROM range(16)) a LEFT JOIN own ON own.plan = p.plan AND own.node = a.node""",
    "ordered_items": _PLAIN + " SELECT row_number() OVER (ORDER BY word) AS pos, word AS item FROM t",
    "sum_by_key": "SELECT l_returnflag AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag",
    "python_reducer": "SELECT event_type AS key, max(event_id) AS largest FROM events GROUP BY event_type",
    "nonstring_key_partition": "SELECT DISTINCT l_orderkey AS key, CAST(0 AS INTEGER) AS pid FROM lineitem",
    "python_map": _PLAIN + " SELECT CAST(length(word) AS BIGINT) AS key, count(*) AS n FROM t GROUP BY ALL",
    "count_merged": _PLAIN + f" SELECT pid, word, n FROM {_MERGED}",
    "sink_round_trip": _PLAIN + f" SELECT pid, word, n FROM {_MERGED}",
    "map_output_round_trip": _PLAIN + " SELECT node, pid % 10 AS pid, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY node, m.pid % 10 HAVING sum(n) > 0",
    "placement_quality": _GREEDY + _CAPPED + _HEAP + """,
asg AS (SELECT DISTINCT 'modulo' AS plan, pid, CAST(pid % 16 AS INTEGER) AS node FROM m UNION ALL SELECT 'locality_capped', pid, node FROM gc WHERE step > 0 UNION ALL SELECT 'load_heap', pid, node FROM gh WHERE step > 0),
own AS (SELECT asg.plan, asg.node, sum(m.n) AS load, sum(CASE WHEN m.node <> asg.node THEN m.n ELSE 0 END) AS moved FROM asg JOIN m ON m.pid = asg.pid GROUP BY asg.plan, asg.node)
SELECT plan, max(load) * 16 / (SELECT sum(n) FROM m) AS most_over_mean, sum(moved) / sum(load) AS moved, CAST((SELECT sum(n) FROM m) - sum(load) AS BIGINT) AS left_out FROM own GROUP BY plan""",
    "place_all_locality_capped": _GREEDY + _CAPPED + """,
x AS (SELECT row_number() OVER (ORDER BY tot DESC, pid) AS k, pid, tot FROM (SELECT DISTINCT pid, tot FROM l) p WHERE pid NOT IN (SELECT pid FROM gc)),
gf AS (
  SELECT CAST(0 AS BIGINT) AS k, -1 AS pid, -1 AS node, (SELECT max_by(loads, step) FROM gc) AS loads
  UNION ALL
  SELECT x.k, x.pid, CAST(list_position(gf.loads, list_min(gf.loads)) - 1 AS INTEGER), list_transform(gf.loads, lambda v, i: CASE WHEN i = list_position(gf.loads, list_min(gf.loads)) THEN v + x.tot ELSE v END)
  FROM gf JOIN x ON x.k = gf.k + 1)
SELECT pid, node, true AS placed FROM gc WHERE step > 0 UNION ALL SELECT pid, node, false FROM gf WHERE k > 0""",
    "ordinal_suffix": "SELECT n, CASE n WHEN 1 THEN '1st' WHEN 2 THEN '2nd' WHEN 3 THEN '3rd' ELSE CAST(n AS VARCHAR) || 'th' END AS label FROM (SELECT CAST(n_nationkey + 1 AS BIGINT) AS n FROM nation) x",
    "truncated_seconds": "SELECT event_id, CAST(trunc(event_id / 4096 * 1000) AS BIGINT) / 1000 AS s FROM events",
    "record_export": r"""
SELECT concat_ws(chr(9), n_name, '2', '100', n_nationkey, n_nationkey + 0.5::DOUBLE, n_regionkey + 0.25::DOUBLE, n_nationkey + 1.5::DOUBLE, n_regionkey + 1.25::DOUBLE, n_nationkey + 2.5::DOUBLE, n_regionkey + 2.25::DOUBLE, n_nationkey + 3.5::DOUBLE) || chr(9) AS line
FROM nation""",
    "shuffle_plan_modulo": _PLAIN + _moves("(SELECT DISTINCT pid, CAST(pid % 16 AS INTEGER) AS node FROM m)"),
    "shuffle_plan_locality_capped": _GREEDY + _CAPPED + _moves("(SELECT pid, node FROM gc WHERE step > 0)"),
    "shuffle_plan_load_heap": _GREEDY + _HEAP + _moves("(SELECT pid, node FROM gh WHERE step > 0)"),
    "task_lists_modulo": _PLAIN + " SELECT CAST(pid % 16 AS INTEGER) AS node, row_number() OVER (PARTITION BY pid % 16 ORDER BY pid) AS seq, pid FROM (SELECT DISTINCT pid FROM m) x",
    "task_lists_locality_capped": _GREEDY + _CAPPED + " SELECT node, row_number() OVER (PARTITION BY node ORDER BY pid) AS seq, pid FROM gc WHERE step > 0",
    "task_lists_load_heap": _GREEDY + _HEAP + " SELECT node, row_number() OVER (PARTITION BY node ORDER BY locality DESC, step) AS seq, pid FROM gh WHERE step > 0",
}
ORACLES["text_directory_count"], ORACLES["record_round_trip"] = ORACLES["word_count"], ORACLES["record_export"]
_LEVELS = "count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, max(l_extendedprice) AS dearest, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem) l"
_WINDOW = "count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, max(event_id) AS last_id"
ORACLES |= {
    "stream_tumbling_windows": f"SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, {_WINDOW} FROM events GROUP BY ALL",
    "stream_sessions": f"""
WITH a AS (SELECT *, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
b AS (SELECT *, sum(CASE WHEN us - before < 43200000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM a)
SELECT min(us) AS start_us, max(us) + 43200000000 AS end_us, user_id, {_WINDOW} FROM b GROUP BY user_id, session""",
    "as_of_join": """
SELECT p.event_id, v.event_id AS view_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "interval_join": """
WITH e AS (SELECT event_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(trunc(value * 60000000) AS BIGINT) AS e FROM events WHERE event_type = 'error'),
p AS (SELECT event_id, epoch_us(ts) AS s, epoch_us(ts) + 600000000 AS e FROM events WHERE event_type = 'purchase')
SELECT e.event_id AS error_id, p.event_id AS purchase_id FROM e JOIN p ON e.s < p.e AND p.s < e.e WHERE e.s < e.e""",
    "cube_distinct": f"SELECT l_returnflag, l_linestatus, year, CAST(grouping(l_returnflag, l_linestatus, year) AS INTEGER) AS level, {_LEVELS} GROUP BY CUBE (l_returnflag, l_linestatus, year)",
    "rollup_distinct": f"SELECT year, l_returnflag, l_linestatus, CAST(grouping(year, l_returnflag, l_linestatus) AS INTEGER) AS level, {_LEVELS} GROUP BY ROLLUP (year, l_returnflag, l_linestatus)",
    "weighted_median": """
WITH a AS (
  SELECT l_returnflag, l_extendedprice AS price, CAST(l_quantity AS BIGINT) AS w, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_returnflag) AS total,
    sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS running FROM lineitem)
SELECT l_returnflag, count(*) AS n, CAST(sum(w) AS BIGINT) AS weight, CAST(min(CASE WHEN 2 * running >= total THEN price END) AS DOUBLE) AS median FROM a GROUP BY l_returnflag""",
    "published_word_count": _PLAIN + f" SELECT pid, word, n FROM {_MERGED}",
    "job_metrics": _PLAIN + " SELECT 'map' AS phase, count(*) AS rows, CAST(sum(octet_length(encode(word))) AS BIGINT) AS bytes FROM t UNION ALL SELECT 'reduce', count(*), CAST(sum(octet_length(encode(word))) AS BIGINT) FROM (SELECT DISTINCT word FROM t) u",
    "sketches_of_days": "SELECT event_type, count(value) AS n, true AS users_near, true AS values_near FROM events GROUP BY event_type",
}
ORACLES |= {"merged_sessions": ORACLES["stream_sessions"], "strict_text_count": ORACLES["word_count"], "stream_text_count": ORACLES["word_count"]}
