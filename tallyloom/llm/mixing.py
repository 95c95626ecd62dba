"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document can belong to several sources. Documents are summed up by pattern (the set of their sources), which makes a
small network on the driver: each pattern gives its words once at cost 0, and again at cost 1, 2, ... for each further
repetition (convex costs); patterns feed the sources they belong to, and sources drain into their targets. Successive
shortest paths route the words. The flow of a (pattern, source) is then drawn from the pattern's documents in the order
of a seeded hash: whole repetitions for all, and one more for those below a threshold; the document at the threshold
gives the part that is left.
"""

from __future__ import annotations

from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACES, own_name, stash

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2
#: The network is on the driver: no more membership patterns than this may share sources with others. Patterns of one
#: source that no other pattern has aren't counted: where there are more patterns in all, they are planned by DataFrame steps.
PATTERNS = 20_000
PLAN = pa.schema([("pattern", pa.list_(pa.string())), ("whole", pa.int32()), ("rest", pa.int64()), ("source_sizes", pa.list_(pa.int64())), ("targets", pa.list_(pa.float64()))])


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(text, F.lit(f"[^{SPACES}]+")).cast("long")


def draw_of(seed: int, doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, F.xxhash64(F.coalesce(text, F.lit(""))))


def targets(sizes: list[int], share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> list[float]:
    """Each source's target, by its place in the order: its weight's part of share * all sizes, and most * its size at most."""
    total, cap = share * sum(sizes), [most * s for s in sizes]
    out: list = [None] * len(sizes)
    while any(x is None for x in out):
        open_ = [i for i, x in enumerate(out) if x is None]
        left = total - sum(x for x in out if x is not None)
        whole = sum(weights[i % len(weights)] for i in open_)
        part = {i: left * weights[i % len(weights)] / whole for i in open_}
        over = [i for i in open_ if part[i] > cap[i]]
        for i in over or open_:
            out[i] = float(cap[i] if over else part[i])
    return out


def route(patterns: list[tuple[frozenset, int]], want: dict, most: int) -> dict[tuple[int, object], int]:
    """Words by (number of pattern, source), of least cost: min-cost flow with costs 0, 1, ... for each repetition.

    Augments along paths of least reduced cost. All costs sit on the patterns' repetitions, so a shortest path is found
    level by level: with repetitions up to k open, flow is augmented (through residual arcs) until none fits, then k + 1.
    """
    flow: dict[tuple[int, object], int] = {}
    used = [0] * len(patterns)
    need = dict(want)
    feeds: dict = {}
    for i, (names, _) in enumerate(patterns):
        for s in names:
            feeds.setdefault(s, []).append(i)
    for level in range(1, most + 1):
        for i, (names, size) in enumerate(patterns):  # direct paths
            for s in sorted(names, key=lambda s: (len(feeds[s]), str(s))):
                x = min(level * size - used[i], need.get(s, 0))
                if x > 0:
                    flow[i, s] = flow.get((i, s), 0) + x
                    used[i] += x
                    need[s] -= x
        while True:  # paths that move what another pattern gave
            start = [i for i, (_, size) in enumerate(patterns) if level * size > used[i]]
            came: dict = {("p", i): None for i in start}
            queue, end = deque(came), None
            while queue and end is None:
                kind, x = at = queue.popleft()
                if kind == "p":
                    steps = [("s", s) for s in sorted(patterns[x][0], key=str)]
                else:
                    if need.get(x, 0) > 0:
                        end = at
                        break
                    steps = [("p", i) for i in feeds.get(x, []) if flow.get((i, x), 0) > 0]
                for to in steps:
                    if to not in came:
                        came[to] = at
                        queue.append(to)
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            first = path[0][1]
            x = min([level * patterns[first][1] - used[first], need[end[1]], *(flow[b[1], a[1]] for a, b in zip(path, path[1:]) if a[0] == "s")])
            for a, b in zip(path, path[1:]):
                k = (a[1], b[1]) if a[0] == "p" else (b[1], a[1])
                flow[k] = flow.get(k, 0) + (x if a[0] == "p" else -x)
            used[first] += x
            need[end[1]] -= x
    return flow


def planned(spark: SparkSession, found: list, share: float, most: int, weights: tuple) -> DataFrame:
    """pattern, whole and rest (what each document gives), source_sizes and targets, by the network over all patterns found."""
    found = in_order(found)
    names = sorted({s for p, _ in found for s in p}, key=lambda s: (s is None, s or ""))  # code points, null last
    size = {s: sum(n for p, n in found if s in p) for s in names}
    target = dict(zip(names, targets([size[s] for s in names], share, most, weights)))
    # all words once, also where patterns overlap
    if any(len(p) > 1 for p, _ in found):
        once = sum(n for _, n in found)
        factor = once / max(1, sum(size.values()))
        target = {s: t * factor for s, t in target.items()}
    return routed(spark, found, size, target, most)


def in_order(found: list) -> list[tuple[tuple, int]]:
    return sorted(((tuple(r["sources"] or (None,)), r["size"]) for r in found), key=lambda x: [(s is None, s or "") for s in x[0]])


def routed(spark: SparkSession, found: list[tuple[tuple, int]], size: dict, target: dict, most: int) -> DataFrame:
    flow = route([(frozenset(p), n) for p, n in found], {s: int(round(t)) for s, t in target.items()}, most)
    gets = Counter()
    for (i, _), x in flow.items():
        gets[i] += x
    plan = [(list(p), int(gets[k] // n) if n else 0, int(gets[k] % n) if n else 0, [int(size[s]) for s in p], [target[s] for s in p]) for k, (p, n) in enumerate(found)]
    columns = zip(*plan) if plan else [()] * 5
    # as Arrow, which Spark reads without Python workers of another kind, that would stay beside the corpus operators'
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, PLAN.types)], schema=PLAN)).coalesce(1)


def plan_of_many(by_pattern: DataFrame, share: float, most: int, weights: tuple) -> DataFrame:
    """What planned() returns, for any number of sources.

    Sources are numbered by ranges, and their targets are found by filling: at level x a source gets its weight * x, or
    its cap; each round closes the sources that are over their cap and raises the level, as targets() does. A pattern
    of one source that no other pattern has gets that source's target. The others go through the network.
    """
    spark = by_pattern.sparkSession
    none = F.array(F.lit(None).cast("string"))
    patterns = stash(by_pattern.select(F.when(F.size("sources") > 0, F.col("sources")).otherwise(none).alias("pattern"), "size").groupBy("pattern").agg(F.sum("size").alias("size")), "patterns")
    members = patterns.select(F.explode("pattern").alias("source"), "size", (F.size("pattern") > 1).alias("mixed"))
    sources = members.groupBy("source").agg(F.sum("size").alias("size"), F.max("mixed").alias("shared"))
    ranged = stash(sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "sources")
    counts, first = {}, 0
    for part, n in sorted(map(tuple, ranged.groupBy("part").count().collect())):  # one row a partition
        counts[part], first = first, first + n
    starts = F.broadcast(spark.createDataFrame(pa.table([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["part", "first"])))
    inside = Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))
    numbered = ranged.withColumn("at", F.row_number().over(inside) - 1).join(starts, "part").withColumn("place", F.pmod(F.col("first") + F.col("at"), F.lit(len(weights))).cast("int"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("place") + 1)
    numbered = stash(numbered.select("source", "size", "shared", weight.alias("weight"), (F.col("size") * float(most)).alias("cap")), "numbered")
    once, total = patterns.agg(F.sum("size")).first()[0], numbered.agg(F.sum("size")).first()[0]
    closed, left, whole = -1, None, None
    while True:  # the level only rises, so a source once over its cap stays so
        over = F.lit(False) if left is None else F.col("weight") * left / whole > F.col("cap")
        n, full, open_ = numbered.agg(F.sum(over.cast("long")), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n <= closed or not open_:
            break
        closed, left, whole = n, share * total - (full or 0.0), open_
    level = F.col("weight") * left / whole
    target = F.when(level > F.col("cap"), F.col("cap")).otherwise(level)
    if once != total:
        target = target * (once / max(1, total))
    goal = stash(numbered.select("source", "size", "shared", target.alias("target")), "targets")
    get = F.rint("target").cast("long")
    lone = goal.where(~F.col("shared")).withColumn("get", get).select(
        F.array("source").alias("pattern"), F.when(F.col("size") > 0, F.expr("get div size")).otherwise(0).cast("int").alias("whole"),
        F.when(F.col("size") > 0, F.expr("get % size")).otherwise(0).cast("long").alias("rest"), F.array("size").alias("source_sizes"), F.array("target").alias("targets"),
    )
    shared = goal.where("shared").select("source", F.col("size").alias("source_size"), "target")
    of = patterns.select("pattern", "size", F.explode("pattern").alias("one")).join(shared, F.col("one").eqNullSafe(F.col("source")), "left_semi")
    mixed = of.groupBy("pattern").agg(F.max("size").alias("size")).select(F.col("pattern").alias("sources"), "size").limit(PATTERNS + 1).collect()
    if len(mixed) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns share sources")
    told = {r["source"]: r for r in shared.collect()} if mixed else {}
    net = routed(spark, in_order(mixed), {s: r["source_size"] for s, r in told.items()}, {s: r["target"] for s, r in told.items()}, most)
    return lone.unionByName(net)


def mix(docs: DataFrame, sources: Column, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, sources, size, taken (words, repetitions counted), and what it was drawn from.

    `sources` is an array column over docs, of one source or several; null is a source of its own, the last one.
    size is 0 for null or empty texts, which are never taken. taken <= most * size. Rows that repeat a doc_id are drawn
    each; ties of the seeded hash go by doc_id, then by size and text hash, so that reruns agree. source_sizes counts a
    document in every source it belongs to. No rows in, no rows out.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.array_sort(F.array_distinct(sources)).alias("sources"))
    rows = own.select("doc_id", "sources", size_of(F.col("text")).alias("size"), draw_of(seed, F.col("doc_id"), F.col("text")).alias("draw"))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("draw", 52).cast("int"))  # 4096 ranges of the hash
    rows = stash(rows, "sizes")
    by_pattern = rows.groupBy("sources").agg(F.sum("size").alias("size"))
    found = by_pattern.limit(PATTERNS + 1).collect()
    many = len(found) > PATTERNS
    plan = plan_of_many(by_pattern, share, most, weights) if many else planned(spark, found, share, most, weights)
    key = lambda c: F.to_json(F.struct(c.alias("p")))
    rows = rows.withColumn("sources", F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.array(F.lit(None).cast("string")))).withColumn("key", key(F.col("sources")))
    near = F.broadcast if not many else lambda df: df
    plan = plan.withColumn("key", key(F.col("pattern"))).drop("pattern")
    plan = near(stash(plan, "plan") if many else plan)
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("n")).withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    edge = sums.join(plan.select("key", "rest"), "key").where("below < rest and below + n >= rest").select("key", F.col("bucket").alias("edge"), "below")  # one row a pattern
    told = rows.join(plan, "key").join(near(edge), "key", "left")
    inside = Window.partitionBy("key").orderBy("draw", "doc_id", "size")
    at_edge = told.where("bucket = edge")
    so_far = F.col("below") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    at_edge = at_edge.withColumn("more", F.least(F.greatest(F.col("rest") - so_far, F.lit(0)), F.col("size")))
    others = told.where("edge is null or bucket <> edge").withColumn("more", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    out = ["doc_id", "sources", "size", "source_sizes", "targets", (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken"), "draw"]
    return at_edge.select(*out).unionByName(others.select(*out))


def repeated(docs: DataFrame, mixed: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of docs, with all their columns, as often as mix() takes them: whole texts only, so that what is taken in
    part, a document at a source's threshold, comes once more if half of it or more is taken.

    Repeated rows of one doc_id and text are drawn as one.
    """
    key, taken, size = (own_name(n, docs) for n in ("key", "taken", "size"))
    of = lambda draw, doc_id: F.concat(draw.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.withColumn(key, of(draw_of(seed, doc_id, F.col("text")), doc_id)).dropDuplicates([key])
    sums = mixed.groupBy(of(F.col("draw"), F.col("doc_id")).alias(key)).agg(F.sum("taken").alias(taken), F.max("size").alias(size)).where(F.col(taken) > 0)
    times = F.expr(f"cast((2 * `{taken}` + `{size}`) div (2 * `{size}`) as int)")
    return rows.join(sums, key).select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array_repeat(F.lit(1), times)).alias(taken)).select(docs.columns)
