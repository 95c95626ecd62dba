"""Components of documents linked by the Jaccard similarity of their word n-grams.

1. Each text becomes a sorted array of distinct 64-bit hashes of its n-grams. Equal sets are one class from here on,
   told apart by 128 bits and their size.
2. Candidate tiles. Sizes fall into bands (powers of two). All n-grams get one total order: n-grams that are popular in
   the corpus last, by a sketch of counts over all texts, others by their hash. A set of n hashes is filed under
   (band, n-gram) for its first n - ceil(share * n) + 1 n-grams in that order, and in the next band too if it's close
   enough to be linked into it. Two linked sets always share such an n-gram, whatever the order, so no link is lost;
   the order keeps passages that unrelated texts share out of the tiles.
3. In a tile, the set that shares most tiles with others is the leader, and the others are held against it. Links give
   components. Where more than a FEW members are outside a tile's largest component, one of them leads next.
4. Tiles that still hold several components are decided pair by pair: those of a FEW members by a join, others in
   blocks of members; members of the largest component are not paired with each other. A tile of over HOT members is first divided by the further n-grams that its sets have in common: linked
   sets share k n-grams among their first n - ceil(share * n) + k, if they share k at all. Sets that are nearly linked have
   most n-grams in common, so that all parts would be as large as the tile, and be divided again: a tile is divided only
   where its parts have few rows for its pairs, and only if they leave at most half of the pairs.
Every candidate pair meets the bitmaps before its sets: a bit flips for each hash that falls on it, so bits that differ
are hashes that differ, which bounds the overlap from above. What is left gets the exact intersection of sorted arrays.
So all pairs in a tile are either decided, or in one component already; no group of copies is expanded into pairs.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, discard, own_name, row_key, shuffle_parts, slices, stash, texts
from .wordhash import mix, mix_other, runs_of_words, text_bytes, words

#: Members of a tile whose pairs are listed by size alone, of a block of a larger tile, members outside its largest
#: component from which on a tile is divided, how often at most, and rounds of further leaders before that.
FEW, BLOCK, HOT, DEEPEST, ROUNDS = 16, 256, 1024, 3, 4
#: Pairs of a tile that cost about as much as a row of a part of it.
PAIRS = 64
#: The sketch of popular n-grams has 2 ** CELLS counts, in parts of PART.
CELLS, PART = 24, 1 << 16
#: Rows whose doc_ids are sent to all tasks, so that their texts are found without a shuffle of the others.
SENT = 1_000_000
#: Pairs that a task holds at a time.
RUN = 1 << 20
SEED, SEED_B = np.uint64(0x51ED270B7A1F39C5), np.uint64(0x8CB92BA72F3D8DD7)


def sets_of(column: pa.Array, width: int):
    """The sorted distinct n-gram hashes of each text: all n-grams, or the whole text if it has fewer words."""
    data, offsets = text_bytes(column)
    h, _, _, first = words(data, offsets, lower=True)
    grams = runs_of_words(h, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield runs_of_words(h[:, a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def popular(docs: DataFrame, width: int) -> np.ndarray:
    """The level of each cell (highest bits of the hash) of n-grams.

    It decides on the order of n-grams alone, never on results. Level 0 is usual; where a cell's count stands out from
    those of its part, its level is a bit length of it. All cells that a task met are summed up, so the driver gets
    2 ** CELLS bytes, whatever the input.
    """

    def count(batches):
        met = np.zeros(1 << CELLS, np.uint32)  # a task has fewer than 2 ** 32 n-grams
        for b in slices(batches):
            data, offsets = text_bytes(b.column("text"))
            h, _, _, _ = words(data, offsets, lower=True)
            cells, n = np.unique(cells_of(runs_of_words(h, width)).astype(np.uint32), return_counts=True)
            met[cells] += n.astype(np.uint32)
        met = met.reshape(-1, PART)
        parts = np.flatnonzero(met.any(1)).tolist()
        counts = [packed(met[k]) for k in parts]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(counts, pa.binary())], ["part", "n"])

    def add(last):
        def apply(batches):
            totals: dict[int, np.ndarray] = {}
            for b in batches:
                for part, n in zip(*(b.column(c).to_pylist() for c in ("part", "n"))):
                    if part not in totals:
                        totals[part] = np.zeros(PART, np.int64)
                    totals[part] += unpacked(n)
            out = [levels_of(t).tobytes() if last else packed(t) for t in totals.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(out, pa.binary())], ["part", "n"])

        return apply

    found = texts(docs).select("text").mapInArrow(count, "part int, n binary")
    # what tasks have counted is summed up in two steps, so that no task gets a part of all of them
    found = found.withColumn("some", F.spark_partition_id() % max(1, math.isqrt(shuffle_parts(docs.sparkSession))))
    told = found.repartition("part", "some").select("part", "n").mapInArrow(add(False), "part int, n binary").repartition("part").mapInArrow(add(True), "part int, n binary")
    told = stash(told, "sketch")  # so that its shuffle is removed
    levels = np.zeros(1 << CELLS, np.uint8)
    for part, found in told.collect():  # one row a part
        levels[part * PART : (part + 1) * PART] = np.frombuffer(found, np.uint8)
    discard(told)
    return levels


def packed(counts: np.ndarray) -> bytes:
    """Counts byte by byte, the lowest bytes first: most are 0 or 1 and nearly all higher bytes are 0, so little is left."""
    return zlib.compress(np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def cells_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - CELLS)).astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """0 for what unpopular n-grams may add up to in a cell, else bit lengths of the counts."""
    usual = float(np.median(counts))
    return np.where(counts > usual + 3 * usual**0.5 + 4, np.frexp(counts)[1], 0).astype(np.uint8)


def in_order(s: np.ndarray, levels: np.ndarray | None) -> np.ndarray:
    """A set's hashes in the common order: the least popular first; without levels by hash."""
    if levels is None:
        return s
    level = levels[cells_of(s)]
    return s[np.argsort(level, kind="stable")] if level.any() else s


def prefix(n: int, share: int) -> int:
    return n - -(-n * share // 100) + 1


def filed(ordered: np.ndarray, share: int) -> np.ndarray:
    """The tiles of a set, as hashes: of its first n-grams in its band, and in the next one if it is close to it."""
    n = len(ordered)
    band = n.bit_length()
    first = ordered[: prefix(n, share)]
    tiles = [mix(first ^ mix(np.array([band], np.uint64) + SEED))]
    if n * 100 >= share << band:
        tiles.append(mix(first ^ mix(np.array([band + 1], np.uint64) + SEED)))
    return np.concatenate(tiles)


def bitmap(s: np.ndarray) -> bytes:
    """Parity bits: two to four times as many as hashes, a power of two."""
    bits = min(1 << 16, max(128, 2 << len(s).bit_length()))
    return np.packbits(np.bincount((mix(s ^ SEED) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def fold(b: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(b, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def near_enough(differ: np.ndarray, sizes: np.ndarray, share: int) -> np.ndarray:
    """Whether sets of so many hashes in sum can be linked if so many bits differ: their overlap is (sizes - differ) / 2 at most."""
    return differ * (100 + share) <= (100 - share) * sizes


def keys_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(mix(s ^ SEED).sum(dtype=np.uint64)) - 2**63, int(mix_other(s + SEED_B).sum(dtype=np.uint64)) - 2**63


def describe(docs: DataFrame, width: int, tiles_of: Callable[[list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """doc_id, row_key, n (size of the set), k1, k2 (128 bits of the set, null if empty), its bitmap, its tiles.

    tiles_of gives the tiles of each of several sets that aren't empty, as uint64.
    """

    def apply(batches):
        for b in slices(batches):
            sets = list(sets_of(b.column("text"), width))
            keys = [keys_of(s) if len(s) else (None, None) for s in sets]
            filled, none = iter(tiles_of([s for s in sets if len(s)])), np.zeros(0, np.uint64)
            tiles = [next(filled) if len(s) else none for s in sets]
            lengths, flat = np.cumsum([0, *map(len, tiles)]), np.concatenate([none, *tiles]).view(np.int64)
            columns = [b.column("doc_id"), b.column("row_key"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array([bitmap(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "n", "k1", "k2", "bits", "tiles"])

    return rows_of(docs).mapInArrow(apply, "doc_id long, row_key string, n long, k1 long, k2 long, bits binary, tiles array<long>")


def by_ngrams(docs: DataFrame, width: int, share: int) -> tuple:
    """describe() with tiles of n-grams, and the broadcast order of n-grams."""
    levels = docs.sparkSession.sparkContext.broadcast(popular(docs, width))
    return describe(docs, width, lambda sets: [filed(in_order(s, levels.value), share) for s in sets]), levels


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and row_key."""
    return with_key(texts(docs))


def with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))


def sets_for(docs: DataFrame, names: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """key and the sorted hashes of the set of each of the keys, which may repeat. names: key, row_key and doc_id of one
    row of its class.

    Of the texts only those of up to SENT rows, found by doc_id, are shuffled; for more rows all texts are.
    """

    def apply(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([s.tobytes() for s in sets_of(b.column("text"), width)], pa.binary())], ["key", "hashes"])

    # written first, so that Spark knows the sizes when it chooses the joins
    keys = stash(keys, "keys")
    wanted = stash(names.join(keys, "key", "left_semi").select("key", "row_key", F.coalesce("doc_id", F.lit(0)).alias("id")), "wanted")
    rows = texts(docs)
    if wanted.count() <= SENT:
        rows = rows.join(F.broadcast(wanted.select("id")), F.coalesce("doc_id", F.lit(0)) == F.col("id"), "left_semi")
    rows = with_key(rows).join(wanted.drop("id"), "row_key").select("key", "text").dropDuplicates(["key"])
    out = stash(rows.mapInArrow(apply, "key long, hashes binary"), "hashes")
    discard(keys, wanted)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def bounded(pairs: DataFrame, maps: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) of keys that the bitmaps don't rule out, written. maps: key, n, bits.

    Pairs and the bitmaps that they need are written first: few of them are joined without a shuffle of all bitmaps.
    """
    pairs = stash(pairs, "pairs")
    if not pairs.limit(1).collect():
        return pairs
    keys = stash(ends_of(pairs), "keys")
    maps = stash(maps.join(keys, "key", "left_semi"), "maps")
    left = maps.select(F.col("key").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x"))
    right = maps.select(F.col("key").alias("b"), "n", F.col("bits").alias("y"))

    def apply(batches):
        for b in batches:
            differ = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                size = min(len(x), len(y))
                differ.append(int(np.bitwise_count((fold(x, size) ^ fold(y, size)).view(np.uint64)).sum()))
            keep = near_enough(np.array(differ, np.int64), b.column("m").to_numpy() + b.column("n").to_numpy(), share)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # the leaders, which many pairs have, first: what their bitmaps are joined to goes on by the other keys, evenly
    near = stash(pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(apply, "a long, b long"), "near")
    discard(pairs, keys, maps)
    return near


def in_runs(batches):
    """Both columns of Arrow batches of pairs, RUN pairs or a batch at a time."""
    held, count = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        count += batch.num_rows
        if count >= RUN:
            yield tuple(map(np.concatenate, zip(*held)))
            held, count = [], 0
    if count:
        yield tuple(map(np.concatenate, zip(*held)))


def ends_of(pairs: DataFrame) -> DataFrame:
    """key of all pairs (a, b): once from each run of a task, so that nothing is shuffled; tasks may repeat each other."""

    def apply(batches):
        for a, b in in_runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([a, b])))], ["key"])

    return pairs.select("a", "b").mapInArrow(apply, "key long")


def verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) of keys that are linked, by exact intersection. sets: key, hashes."""
    left = sets.select(F.col("key").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("hashes").alias("y"))

    def apply(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                keep = []
                for x, y in zip(b.column("x"), b.column("y")):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    same = overlap(x, y)
                    keep.append(100 * same >= share * (len(x) + len(y) - same))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(apply, "a long, b long")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key that the links connect to a smaller one, and the smallest key that it is connected to."""
    keys, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    label = np.arange(len(keys))
    while len(u):
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label != (further := label[label])).any():
            label = further
        u, v = label[u], label[v]
        u, v = u[u != v], v[u != v]
    more = np.flatnonzero(label != np.arange(len(keys)))
    return keys[more], keys[label[more]]


def starred(links: DataFrame) -> DataFrame:
    """Links u > v with the same components, written: what a run of a task connects is linked to the smallest key of it.

    Done twice, as the first time leaves less, which fewer tasks read together.
    """

    def apply(batches):
        for u, v in in_runs(batches):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, stars(u, v))), ["u", "v"])

    once = stash(links.mapInArrow(apply, "u long, v long"), "stars")
    out = stash(once.mapInArrow(apply, "u long, v long"), "edges")
    discard(once)
    return out


def components(links: DataFrame) -> DataFrame:
    """key and label (the smallest key it is connected to) of all keys in links (a, b), written.

    Repeated links and links given in both directions count once; a key linked with itself alone isn't in the result.
    Tasks connect what they hold; then large-star and small-star steps, each over shuffled rows, until every key is a
    smallest one or linked with such a one alone; the number of rounds grows with the logarithm of a component's size.
    """
    edges = starred(links.where("a <> b").select("a", "b"))
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        known = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.when(F.col("v") < F.col("u"), F.col("v"))).alias("next"))
        known = known.select(F.col("u").alias("key"), F.least("u", "low").alias("label"), (F.col("next").isNull() | ((F.col("next") == F.col("low")) & (F.col("high") < F.col("u")))).alias("settled"))
        known = stash(known, "known")
        if not known.where("not settled").limit(1).collect():
            discard(edges)
            return known.select("key", "label")
        large = both.where("v > u").join(known.select(F.col("key").alias("u"), F.col("label").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        new = stash(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v"), "links")
        discard(edges, known)
        edges = starred(new)
        discard(new)


def compared(left: np.ndarray, right: np.ndarray, t: dict, share: int) -> tuple[list, list]:
    """Keys of the pairs of rows of left and right, of different components, that sizes and bitmaps don't rule out; a row
    that is in both meets those of smaller keys."""
    a, b = [], []
    n, key, label, bits = t["n"], t["key"], t["label"], t["bits"]
    both = np.zeros(len(n), bool)
    both[left] = True
    for x in left:
        ok = (label[right] != label[x]) & (100 * np.minimum(n[right], n[x]) >= share * np.maximum(n[right], n[x])) & (~both[right] | (key[right] < key[x]))
        near = right[ok]
        if len(near):
            near = near[near_enough(np.bitwise_count(bits[near] ^ bits[x]).sum(1), n[near] + n[x], share)]
            a += [key[x]] * len(near)
            b += key[near].tolist()
    return a, b


def columns_of(t: pa.Table) -> dict:
    raw = t.column("bits").to_pylist()
    size = min(map(len, raw), default=0)
    bits = np.stack([fold(b, size) for b in raw]).view(np.uint64)
    return {c: t.column(c).to_numpy() for c in ("n", "key", "label", "own")} | {"bits": bits}


def in_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def lopsided_pairs(tiles: DataFrame, share: int) -> DataFrame:
    """Candidate pairs in tiles of few members outside the largest component: those meet each block of the tile.

    tiles: tile, members, key, n, bits, label, top (label of the largest component). Of two members outside it, the one
    of the larger key meets the other in its own block.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = tiles.withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    every = F.sequence(F.lit(0), blocks - 1)
    rows = rows.withColumn("block", F.explode(F.when(F.col("label") == F.col("top"), F.array("own")).otherwise(every)))
    rows = rows.select("tile", "block", "own", "key", "n", "bits", "label", (F.col("label") == F.col("top")).alias("inside"))

    def apply(t: pa.Table) -> pa.Table:
        block, inside = t.column("block")[0].as_py(), t.column("inside").to_numpy(zero_copy_only=False)
        t = columns_of(t)
        outside, here = np.flatnonzero(~inside), np.flatnonzero(~inside & (t["own"] == block))
        a, b = compared(outside, np.flatnonzero(inside), t, share)
        if len(here):
            # all of `outside` are told apart by key, so that each pair is met once
            for x in here:
                c, d = compared(np.array([x]), outside[t["key"][outside] < t["key"][x]], t, share)
                a, b = a + c, b + d
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return in_pairs(rows.groupBy("tile", "block").applyInArrow(apply, "a long, b long"))


def close_pairs(tiles: DataFrame, share: int) -> DataFrame:
    """Candidate pairs in any tile. tiles: tile, members, outside, key, n, bits, label, top (label of the largest component).

    Blocks of a tile, those of its largest component apart, are given out by hash, and each two blocks, of which one is
    outside that component, are one group of about 4 * BLOCK rows.
    """
    outer, inner = (F.ceil(F.col(c) / (2 * BLOCK)).cast("int") for c in ("outside", "within"))
    inside = F.col("label") == F.col("top")
    rows = tiles.withColumn("within", F.col("members") - F.col("outside"))
    rows = rows.withColumn("own", F.when(inside, outer + F.pmod(F.xxhash64("key"), inner)).otherwise(F.pmod(F.xxhash64("key"), outer)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), outer + F.when(inside, 0).otherwise(inner) - 1)))
    rows = rows.select("tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "n", "bits", "label")

    def apply(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        t = columns_of(t)
        a, b = compared(np.flatnonzero(t["own"] == i), np.flatnonzero(t["own"] == j), t, share)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return in_pairs(rows.groupBy("tile", "i", "j").applyInArrow(apply, "a long, b long"))


def few_pairs(tiles: DataFrame, share: int) -> DataFrame:
    """Pairs of keys of different components in a tile whose sizes are near enough. tiles: tile, key, n, label."""
    one, two = (tiles.select("tile", *(F.col(c).alias(f"{c}_{k}") for c in ("key", "n", "label"))) for k in "ab")
    pairs = one.join(two, "tile").where((F.col("key_a") > F.col("key_b")) & (F.col("label_a") != F.col("label_b")) & (100 * F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b")))
    return pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()


def divided(rows: DataFrame, levels, share: int, k: int) -> DataFrame:
    """tile, key, at of the parts of tiles, and of (the tile that was divided). rows: tile, key, at (place of the tile's last n-gram, null at first), hashes.

    A set goes to the parts of its n-grams after that place, among the first that linked sets share k + 1 of. Sets too
    small for k + 1 shared n-grams meet in one more part. levels: the broadcast order of n-grams, None if by hash.
    """

    def apply(batches):
        for b in batches:
            tiles, keys, places, whole = [], [], [], []
            for tile, key, at, raw in zip(b.column("tile").to_pylist(), b.column("key").to_pylist(), b.column("at").to_pylist(), b.column("hashes")):
                s = in_order(np.frombuffer(raw.as_buffer(), np.uint64), levels and levels.value)
                n = len(s)
                if at is None:
                    at = int(np.flatnonzero(filed(s, share).view(np.int64) == tile)[0]) % prefix(n, share)
                place = np.arange(at + 1, min(n, prefix(n, share) + k))
                old = np.array([tile], np.int64).view(np.uint64)
                part = mix(mix(s[place]) + old)
                if -(-n * share // 100) <= k:
                    place, part = np.append(place, n), np.append(part, mix_other(old))
                tiles.append(part.view(np.int64))
                keys.append(np.full(len(part), key, np.int64))
                places.append(place.astype(np.int32))
                whole.append(np.full(len(part), tile, np.int64))
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tiles or none)), pa.array(np.concatenate(keys or none)), pa.array(np.concatenate(places or none).astype(np.int32)), pa.array(np.concatenate(whole or none))], ["tile", "key", "at", "of"])

    return rows.select("tile", "key", "at", "hashes").mapInArrow(apply, "tile long, key long, at int, of long")


def undecided(told: DataFrame) -> DataFrame:
    """The rows (tile, key, label, ...) of tiles that hold several components, with the tile's number of members, those
    outside its largest component, and that component's label."""
    sizes = told.groupBy("tile", "label").agg(F.count(F.lit(1)).alias("c"))
    open_ = sizes.groupBy("tile").agg(F.sum("c").alias("members"), F.max(F.struct("c", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    return told.join(open_.select("tile", "members", (F.col("members") - F.col("most.c")).alias("outside"), F.col("most.label").alias("top")), "tile")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels with further links between the components."""
    ends = [labels.select(F.col("key").alias(c), F.col("label").alias(f"{c}_label")) for c in "ab"]
    links = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(*(F.coalesce(f"{c}_label", c).alias(c) for c in "ab"))
    joined = components(links).select(F.col("key").alias("label"), F.col("label").alias("least"))
    old = labels.join(joined, "label", "left").select("key", F.coalesce("least", "label").alias("label"))
    new = joined.join(labels, joined["label"] == labels["key"], "left_anti").select(F.col("label").alias("key"), F.col("least").alias("label"))
    return stash(old.unionByName(new), "labels")


def labelled(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    return tiles.select("tile", "key", "n").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))


def led_on(tiles: DataFrame, labels: DataFrame, maps: DataFrame, link, share: int) -> tuple[DataFrame, DataFrame]:
    """The labels after rounds in which a member outside the largest component leads its tile, and undecided() of what
    tiles are open. Tiles of a FEW members outside it are left aside by the rounds."""
    aside, lying, rest, fresh = [], [], tiles, False
    for k in range(ROUNDS):
        lying.append(stash(undecided(labelled(rest, labels)), "open"))
        if rest is tiles:
            discard(tiles)
        rest, fresh = lying[-1].where(F.col("outside") > FEW), True
        if not rest.limit(1).collect():
            break
        leaders = rest.where("label <> top").groupBy("tile").agg(F.max(F.struct(F.xxhash64("key", F.lit(k)).alias("draw"), F.col("key").alias("a"), F.col("n").alias("m"), F.col("label").alias("of"))).alias("one")).select("tile", "one.*")
        pairs = rest.join(leaders, "tile").where((F.col("label") != F.col("of")) & (100 * F.least("n", "m") >= share * F.greatest("n", "m")))
        links = link(bounded(pairs.select("a", F.col("key").alias("b")).distinct(), maps, share))
        if not links.limit(1).collect():
            break
        labels, fresh = merged(labels, links), False
        aside.append(lying[-1].where(F.col("outside") <= FEW))
    # what has been looked at with these labels stays as it is
    told = [lying[-1]] if fresh else []
    old = aside if fresh else [*aside, rest]
    if old:
        told.append(stash(undecided(labelled(functools.reduce(DataFrame.unionByName, old), labels)), "open"))
        discard(*lying[: len(lying) - fresh])
    return labels, told


def pairs_left(told: list[DataFrame], maps: DataFrame, sets_of_keys, levels, share: int) -> DataFrame:
    """Candidate pairs of different components in the tiles; some may come repeatedly. told: tables of tile, key, n, label and undecided()'s columns,
    which are removed.

    Tiles of n-grams are divided by further ones; other tiles (levels is None) by n-grams from the first on. What division
    doesn't make smaller is decided as it is, in blocks, so that the work is never more than a few times that of all pairs.
    """
    rest = functools.reduce(DataFrame.unionByName, told).withColumn("at", F.lit(-1 if levels is None else None).cast("int"))
    out, done, size, outside = [], [*told], F.col("members"), F.col("outside")

    def with_bits(rows):
        done.append(stash(rows, "some"))  # so that few rows are joined without a shuffle of all bitmaps
        return done[-1].join(maps.select("key", "bits"), "key")

    def in_blocks(rows):
        out.append(stash(close_pairs(with_bits(rows), share), "close"))

    for k in range(levels is not None, DEEPEST + 2):
        hot = (size > FEW) & (outside > HOT)
        out.append(bounded(few_pairs(rest.where(size <= FEW), share), maps, share))
        out.append(stash(lopsided_pairs(with_bits(rest.where((size > FEW) & ~hot)), share), "lopsided"))
        rest = rest.where(hot)
        if not rest.limit(1).collect():
            break
        if k > DEEPEST:
            in_blocks(rest)
            break
        n = F.col("n")
        rows = F.least(n, n - F.ceil(n * share / 100) + 1 + k) - F.coalesce("at", F.lit(0))  # at most, of each member
        costs = rest.groupBy("tile").agg(F.sum(rows).alias("rows"), F.first(size * outside).alias("pairs")).select("tile", "pairs", (F.col("rows") * PAIRS < F.col("pairs")).alias("small"))
        rest = stash(rest.join(costs, "tile"), "hot")
        done.append(rest)
        in_blocks(rest.where("not small"))
        rest = rest.where("small")
        if not rest.limit(1).collect():
            break
        names = rest.select("key", "n", "label").distinct()
        sets = sets_of_keys(names.select("key"))
        parts = stash(undecided(divided(rest.join(sets, "key"), levels, share, k).join(names, "key")), "undecided")
        done.append(parts)
        discard(sets)
        left = parts.groupBy("of", "tile").agg(F.first(size * outside).alias("left")).groupBy("of").agg(F.sum("left").alias("left"))
        whole = rest.select("tile", "pairs").distinct().join(left, F.col("tile") == F.col("of")).where(2 * F.col("left") > F.col("pairs")).select("of")
        whole = stash(whole, "whole")
        done.append(whole)
        in_blocks(rest.join(whole, F.col("tile") == F.col("of"), "left_semi"))
        rest = parts.join(whole, "of", "left_anti")
    discard(*done)
    return functools.reduce(DataFrame.unionByName, out)


def linked(docs: DataFrame, width: int, share: int, filing: Callable[[DataFrame, int, int], tuple] = by_ngrams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, row_key, n, k1, k2), classes (k1, k2, n, key, row_key and doc_id of one row: the one with the smallest
    doc_id, null being the largest, and of those the smallest row_key) and the label of keys that have links.

    filing gives what describe() returns, and the order of n-grams, None if its tiles aren't n-grams.
    """
    if not 50 <= share <= 100:
        raise ValueError("share must be 50 to 100")
    found, levels = filing(docs, width, share)
    every = stash(found, "filed")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    classes = every.where("k1 is not null").groupBy("k1", "k2", "n").agg(F.first("tiles").alias("tiles"), F.first("bits").alias("bits"), F.min(place).alias("row")).select("k1", "k2", "n", "tiles", "bits", "row.doc_id", "row.row_key")
    classes = stash(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    described = stash(every.drop("tiles", "bits"), "sets")
    discard(every)
    entries = classes.select("key", "n", F.explode("tiles").alias("tile"))
    # counted map-side and joined, as Spark divides a join on a frequent tile, but not a window
    counts = entries.groupBy("tile").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    # a key has no more entries than its own n-grams, or bands
    shared_ = stash(entries.join(counts, "tile").withColumn("weight", F.sum("members").over(Window.partitionBy("key"))), "weighed")
    names, maps = stash(classes.drop("tiles", "bits"), "names"), stash(classes.select("key", "n", "bits"), "bitmaps")
    discard(classes)
    leaders = shared_.groupBy("tile").agg(F.max(F.struct("weight", F.negative("n").alias("n"), F.col("key").alias("leader"))).alias("top"))
    pairs = shared_.join(leaders, "tile").where((F.col("key") != F.col("top.leader")) & (100 * F.least(F.col("n"), -F.col("top.n")) >= share * F.greatest(F.col("n"), -F.col("top.n"))))
    near = bounded(pairs.select(F.col("top.leader").alias("a"), F.col("key").alias("b")).distinct(), maps, share)
    sets_of_keys = lambda keys: sets_for(docs, names, keys, width)

    def link(found: DataFrame, repeated: bool = False) -> DataFrame:
        if not found.limit(1).collect():
            return found
        sets = sets_of_keys(ends_of(found))
        links = stash(verified(found.distinct() if repeated else found, sets, share), "links")
        discard(sets)
        return links

    labels, open_ = led_on(shared_, components(link(near)), maps, link, share)
    more = link(pairs_left(open_, maps, sets_of_keys, levels, share), repeated=True)
    return described, names, merged(labels, more) if more.limit(1).collect() else labels


def jaccard_components(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (size of its set), component_id.

    The set has the distinct n-grams of `width` words of the text with A-Z in lower case; with fewer words the whole
    sequence is one n-gram, and without words, or with a null text, the set is empty and linked with nothing. Documents
    are linked when 100 * intersection >= share * union. component_id is the smallest doc_id reachable by links, the
    document's own included; a null doc_id is never the smallest. Rows that repeat a doc_id are rows of their own.
    Equal sets are linked, so exact copies and repeated rows are in one component. No rows in, no rows out. share is 50
    to 100: bands are that wide. No candidate is left out; n-grams are compared as 64-bit hashes of 128-bit words.
    """
    return component_ids(*linked(docs, width, share))


def component_ids(described: DataFrame, names: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of what linked() gives."""
    classes = names.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    told = classes.join(classes.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("k1", "k2", "n", "component_id")
    out = described.join(told, ["k1", "k2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def components_kept(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """doc_id and row_key of the row that stays of each component of texts with words: the one with the smallest doc_id,
    null being the largest; of several rows with that doc_id, the one with the smallest row_key."""
    _, names, labels = linked(docs, width, share)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    reps = names.join(labels, "key", "left").groupBy(F.coalesce("label", "key").alias("label")).agg(F.min(place).alias("rep"))
    return reps.select("rep.doc_id", "rep.row_key")


def rows_kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that components_kept names, of repeated rows one; and every row without
    words, as it is linked with nothing."""
    name = own_name("row_key", docs)
    rows = docs.withColumn(name, row_key(F.col("doc_id").cast("long"), F.col("text")))
    has_words = F.coalesce("text", F.lit("")).rlike(f"[^{SPACES}]")
    some = rows.where(has_words).join(kept.select(F.col("row_key").alias(name)), name, "left_semi").dropDuplicates([name])
    return some.unionByName(rows.where(~has_words)).select(docs.columns)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * same >= 85 * (m.n + o.n - same)),
r AS (SELECT a AS doc_id, b AS root FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.root = l.a),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.root, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
