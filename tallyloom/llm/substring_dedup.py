"""Removal of repeated passages, by FM-indexes over shards of candidate runs.

A window is `width` words in a row. Words covered by a window that also starts in a document with a smaller doc_id go.

1. Of the `GRAM`-word grams of a window the one with the smallest hash is the window's anchor, which depends on the
   window's words alone. A document's anchors are counted over all documents. A window whose anchor occurs once can't be
   repeated. Of documents with the same words, by 128 bits, the first is searched, with all of its windows.
2. The windows that share an occurrence of an anchor are a run of words. Runs go to the shard of their anchor, so that
   equal windows meet in one shard; equal runs are put together before, with the smallest doc_id they occur in. An
   anchor of over HEAVY distinct runs is divided: its windows go by their two least grams, then three, and so on, until
   the last step, where all grams of a window count and only equal windows are together.
3. Each shard has its own FM-index: a Burrows-Wheeler transform over word numbers in a wavelet tree of packed bits with
   rank counts, and 32 bits for the document of each suffix; suffixes are sorted up to the window's length, and the
   suffix array itself isn't kept. The shard's runs are streamed against it: backward search from each window's last
   word gives the matching statistics (the longest match that occurs elsewhere too, up to the window's length), and
   where they reach the threshold, the first document of the range of suffixes tells whether the window is to go.
4. The intervals found are joined to the occurrences of their runs, and the documents' words are kept or dropped. The
   windows that were found of a document decide on those with the same words too.
Hashes of grams only say where windows meet; in a shard words are compared themselves.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, shuffle_parts, slices, stash, texts
from .wordhash import mix, runs_of_words, text_bytes, words

GRAM = 6
#: Runs of a shard, and distinct runs of an anchor from which on it is divided.
SHARD, HEAVY = 20_000, 2_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = "key long, run binary, id1 long, id2 long, doc_id long, of long, start long"


def anchors(h: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the grams of words, place of each window's anchor: its leftmost gram of least hash).

    Over the words of a block; windows that cross from one text into the next are for the caller to leave out.
    """
    g = runs_of_words(h, gram)
    n, span = h.shape[1] - width + 1, width - gram + 1
    if n <= 0:
        return g, np.zeros(0, np.int64)
    best, least = np.arange(n), g[:n].copy()
    for i in range(1, span):
        better = g[i : i + n] < least
        best[better] = np.flatnonzero(better) + i
        np.minimum(least, g[i : i + n], out=least)
    return g, best


def digests(values: list[bytes]) -> np.ndarray:
    """128 bits of each value, in two columns."""
    return np.frombuffer(b"".join(hashlib.blake2b(v, digest_size=16).digest() for v in values), "<i8").reshape(-1, 2)


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and of, which tells the texts of one doc_id apart."""
    return texts(docs).withColumn("of", F.xxhash64("text"))


def describe(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """doc_id, of, n_words, w1, w2 (128 bits of all its words in order), anchors (distinct, as hashes)."""

    def apply(batches):
        for b in slices(batches):
            data, offsets = text_bytes(b.column("text"))
            h, _, _, first = words(data, offsets, lower=False)
            edges = list(zip(first[:-1].tolist(), first[1:].tolist()))
            whole = digests([h[:, a:z].tobytes() for a, z in edges])
            g, at = anchors(h, width, gram)
            found = [np.unique(g[at[a : max(a, z - width + 1)]]).view(np.int64) for a, z in edges]
            ends = np.cumsum([0, *map(len, found)])
            flat = pa.array(np.concatenate(found)) if found else pa.array([], pa.int64())
            columns = [b.column("doc_id"), b.column("of"), pa.array(np.diff(first)), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "of", "n_words", "w1", "w2", "anchors"])

    return rows_of(docs).mapInArrow(apply, "doc_id long, of long, n_words long, w1 long, w2 long, anchors array<long>")


def run_batch(keys: list, runs: list[bytes], docs: list, ofs: list, starts: list) -> pa.RecordBatch:
    ids = digests(runs)
    joined = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (keys, docs, ofs, starts)]
    columns = [joined[0], pa.array(runs, pa.binary()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), *joined[1:]]
    return pa.RecordBatch.from_arrays(columns, ["key", "run", "id1", "id2", "doc_id", "of", "start"])


def runs_of(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """rows: doc_id, of, text, hits (anchors that occur again). key (the anchor), run (its words), its 128 bits, doc_id, of, start (first word)."""

    def apply(batches):
        for b in slices(batches, 500_000):
            data, offsets = text_bytes(b.column("text"))
            h, starts, ends, first = words(data, offsets, lower=False)
            g, at = anchors(h, width, gram)
            odd = np.cumsum(np.append(0, (starts[1:] != ends[:-1] + 1) | (data[ends[:-1]] != 32)))  # gaps that aren't one space
            found: tuple = ([], [], [], [])
            names = zip(b.column("doc_id").to_pylist(), b.column("of").to_pylist())
            raw, runs = data.tobytes(), []
            for (doc, of), hits, a, z in zip(names, b.column("hits"), first[:-1].tolist(), first[1:].tolist()):
                own = at[a : max(a, z - width + 1)]
                hit = np.isin(g[own], hits.values.to_numpy(zero_copy_only=False).view(np.uint64))
                turn = own[1:] != own[:-1]
                new, last = a + np.flatnonzero(hit & np.append(True, turn)[: len(own)]), a + np.flatnonzero(hit & np.append(turn, True)[: len(own)]) + width - 1
                plain = odd[new] == odd[last]
                for s, e, p, q, ok in zip(starts[new].tolist(), ends[last].tolist(), new.tolist(), last.tolist(), plain.tolist()):
                    runs.append(raw[s:e] if ok else b" ".join(raw[starts[k] : ends[k]] for k in range(p, q + 1)))
                for to, x in zip(found, (g[at[new]].view(np.int64), np.full(len(new), doc, np.int64), np.full(len(new), of, np.int64), new - a)):
                    to.append(x)
            yield run_batch(found[0], runs, *found[1:])

    return rows.mapInArrow(apply, RUNS)


def divided(runs: DataFrame, width: int, gram: int, k: int) -> DataFrame:
    """The runs cut into runs of windows that agree in their k least grams; at the last k each window by itself."""
    span = width - gram + 1

    def apply(batches):
        for b in slices(batches, 500_000, "run"):
            data, offsets = text_bytes(b.column("run"))
            h, starts, ends, first = words(data, offsets, lower=False)
            g = runs_of_words(h, gram)
            found: tuple = ([], [], [], [])
            raw, runs = data.tobytes(), []
            names = zip(*(b.column(c).to_pylist() for c in ("doc_id", "of", "start")))
            for (doc, of, start), a, z in zip(names, first[:-1].tolist(), first[1:].tolist()):
                least = np.sort(np.lib.stride_tricks.sliding_window_view(g[a : z - gram + 1], span), 1)
                key = np.zeros(len(least), np.uint64)
                for i in range(k):
                    key = mix(key + least[:, i])
                turn = key[1:] != key[:-1] if k < span else np.ones(len(key) - 1, bool)
                new, last = np.flatnonzero(np.append(True, turn)), np.flatnonzero(np.append(turn, True)) + width - 1
                runs += [raw[starts[a + p] : ends[a + q]] for p, q in zip(new.tolist(), last.tolist())]
                for to, x in zip(found, (key[new].view(np.int64), np.full(len(new), doc, np.int64), np.full(len(new), of, np.int64), start + new)):
                    to.append(x)
            yield run_batch(found[0], runs, *found[1:])

    return runs.select("run", "doc_id", "of", "start").mapInArrow(apply, RUNS)


class WaveletTree:
    """Rank of symbols in a sequence, by a bit-sliced wavelet tree (levels from the highest bit down)."""

    def __init__(self, values: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        left = values.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = (left >> np.uint32(level)) & np.uint32(1)
            room = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            room[: len(bit)] = bit
            packed = np.packbits(room, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(packed).astype(np.uint32)
            self.bits.append(packed)
            self.before.append(np.cumsum(counts, dtype=np.uint32) - counts)
            self.zeros.append(np.uint32(len(bit) - int(bit.sum())))
            left = np.concatenate([left[bit == 0], left[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray, low: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place `at`. low: the symbol's first place at the bottom (`starts`)."""
        at = at.astype(np.uint32)
        for level, (bits, before, zeros) in enumerate(zip(self.bits, self.before, self.zeros)):
            block = at >> np.uint32(6)
            mask = (np.uint64(1) << (at & np.uint32(63)).astype(np.uint64)) - np.uint64(1)
            ones = before[block] + np.bitwise_count(bits[block] & mask).astype(np.uint32)
            up = (symbol >> np.uint32(self.levels - 1 - level)) & np.uint32(1)
            at = np.where(up == 1, zeros + ones, at - ones)
        return at - low

    def starts(self, n_symbols: int) -> np.ndarray:
        every = np.arange(n_symbols, dtype=np.uint32)
        return self.rank(every, np.zeros(n_symbols, np.uint32), np.zeros(n_symbols, np.uint32))


class FMIndex:
    """Over a sequence of symbols from 1 on, in which 0 ends each run; suffixes are told apart up to `depth` symbols.

    owner: a number below 2 ** 32 for each place; what is kept of the suffix array is the owner of each suffix.
    """

    def __init__(self, sequence: np.ndarray, depth: int, owner: np.ndarray):
        n, self.n = len(sequence), len(sequence)
        self.n_symbols = int(sequence.max(initial=0)) + 1
        rank, reach = sequence.astype(np.int64), 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - reach)] = rank[reach:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + ahead
            order = np.argsort(key)  # suffixes that agree up to the depth can stand in any order
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1])) if n else 0
            reach *= 2
            if reach >= depth:
                break
        self.owners = owner[order].astype(np.uint32)
        self.tree = WaveletTree(sequence[order - 1], self.n_symbols)
        self.low = self.tree.starts(self.n_symbols)
        self.first = np.cumsum(np.bincount(sequence, minlength=self.n_symbols)) - np.bincount(sequence, minlength=self.n_symbols)

    def search(self, sequence: np.ndarray, last: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search from each place in `last`: (matching statistic up to depth, range of suffixes of the match).

        The places are the index's own, so a match that is alone is the place itself, and goes no further.
        """
        low, high = np.zeros(len(last), np.int64), np.full(len(last), self.n, np.int64)
        length = np.zeros(len(last), np.int64)
        live = np.arange(len(last))
        for step in range(depth):
            symbol = sequence[last[live] - step]
            at = self.tree.rank(np.concatenate([symbol, symbol]).astype(np.uint32), np.concatenate([low[live], high[live]]), np.concatenate([self.low[symbol]] * 2))
            a, b = self.first[symbol] + at[: len(live)], self.first[symbol] + at[len(live) :]
            more = b - a > 1
            live, a, b = live[more], a[more], b[more]
            low[live], high[live], length[live] = a, b, step + 1
            if not len(live):
                break
        return length, low, high

    def first_owners(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least owner in each range; ranges that begin alike are equal, and each is looked through once."""
        low, at, of = np.unique(low, return_index=True, return_inverse=True)
        edges = np.stack([low, high[at]], 1).ravel()
        return np.minimum.reduceat(np.append(self.owners, np.uint32(2**32 - 1)), edges)[::2][of] if len(low) else np.zeros(0, np.uint32)


def shard_windows(runs: list[bytes], doc_ids: np.ndarray, width: int) -> list[np.ndarray]:
    """For each run the smallest doc_id of each of its windows."""
    by_doc = np.argsort(doc_ids, kind="stable")
    runs, doc_ids = [runs[k] for k in by_doc.tolist()], doc_ids[by_doc]  # so that a run's number says which doc_id is less
    parts = [r.split(b" ") for r in runs]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    names: dict = {}
    flat = np.fromiter((names.setdefault(w, len(names) + 1) for p in parts for w in [*p, None]), np.int64, int(lengths.sum()) + len(parts)) if parts else np.zeros(0, np.int64)
    end = names.get(None, 0)
    flat = np.where(flat == end, 0, np.where(flat > end, flat - 1, flat)) if end else flat
    starts = np.cumsum(lengths + 1) - lengths - 1
    index = FMIndex(flat, width + 1, np.repeat(np.arange(len(parts)), lengths + 1))
    windows = np.maximum(0, lengths - width + 1)
    run = np.repeat(np.arange(len(parts)), windows)
    begin = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[run]
    length, low, high = index.search(flat, begin + width - 1, width)
    # where the match falls short, the window is alone
    found = doc_ids[run].copy()
    whole = np.flatnonzero(length == width)
    found[whole] = doc_ids[index.first_owners(low[whole], high[whole])]
    out: list = [None] * len(runs)
    for k, x in zip(by_doc.tolist(), np.split(found, np.cumsum(windows)[:-1])):
        out[k] = x
    return out


def repeated_windows(runs: DataFrame, width: int) -> DataFrame:
    """runs: shard, id1, id2, run, doc_id (least). id1, id2, least (smallest doc_id of each window)."""

    def apply(t: pa.Table) -> pa.Table:
        found = shard_windows(t.column("run").to_pylist(), t.column("doc_id").to_numpy(), width)
        return pa.table({"id1": t.column("id1"), "id2": t.column("id2"), "least": pa.array(found, pa.list_(pa.int64()))})

    return runs.groupBy("shard").applyInArrow(apply, "id1 long, id2 long, least array<long>")


def keep_words(rows: DataFrame, width: int) -> DataFrame:
    """rows: doc_id, text, low and high (windows from low to high - 1 go), gone (first words of more windows to remove)."""

    def apply(batches):
        for b in slices(batches):
            out: tuple = ([], [], [], [])
            for text, low, high, gone in zip(*(b.column(c).to_pylist() for c in ("text", "low", "high", "gone"))):
                own = WORD.findall(text)
                n = len(own)
                if gone or low is not None:
                    edge = np.zeros(n + 1, np.int64)
                    at = np.unique(np.array(gone or [], np.int64))
                    edge[at] += 1
                    edge[at + width] -= 1
                    if low is not None:
                        edge[low] += 1
                        edge[high - 1 + width] -= 1
                    keep = np.cumsum(edge[:-1]) == 0
                    own = [w for w, k in zip(own, keep.tolist()) if k]
                kept = " ".join(own)
                for to, x in zip(out, (n, n - len(own), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept)):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def substring_dedup(docs: DataFrame, width: int = 13, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept (the words kept, joined by a space).

    Words are runs of anything but the six white-space characters, unchanged; a null text has none. A word goes if a
    window of `width` words that covers it also starts in a document with a smaller doc_id; windows are judged on the
    input. Repeats within one document alone stay. Documents of fewer words stay whole. Rows that repeat a doc_id are
    each judged by themselves, and none repeats another; rows without a doc_id are compared with none and stay whole.
    No rows in, no rows out.
    """
    spark = docs.sparkSession
    one = ["doc_id", "of"]  # a text of a document
    every = stash(describe(docs, width, gram), "anchors")
    described = every.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= width))
    whole = ["w1", "w2", "n_words"]
    firsts = described.groupBy(*whole).agg(F.min(F.struct(*one)).alias("first"))
    copies = described.select(*one, *whole).join(firsts, whole).where("first.doc_id < doc_id")
    copies = stash(copies.select(*one, F.col("first.doc_id").alias("first_id"), F.col("first.of").alias("first_of")).distinct(), "copies")  # of the same words as a document before it
    copied = copies.select(F.col("first_id").alias("doc_id"), F.col("first_of").alias("of")).distinct()
    own = described.join(copies, one, "left_anti").join(copied.withColumn("copied", F.lit(1)), one, "left")
    own = own.select("doc_id", F.explode("anchors").alias("anchor"), (F.coalesce("copied", F.lit(0)) + 1).alias("n"))
    twice = own.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    hits = stash(own.join(twice, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("hits")), "hits")
    discard(every)
    runs = [stash(runs_of(rows_of(docs).join(hits, "doc_id"), width, gram), "runs")]
    discard(hits)
    distinct = []
    for k in range(2, width - gram + 3):
        here = stash(runs[-1].groupBy("key", "id1", "id2").agg(F.min("doc_id").alias("doc_id"), F.first("run").alias("run")), "distinct-runs")
        heavy = stash(here.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(f"n > {HEAVY}").select("key"), "heavy")
        if k > width - gram + 1 or not heavy.limit(1).collect():
            distinct.append(here)
            break
        distinct.append(here.join(heavy, "key", "left_anti"))
        runs.append(stash(divided(runs[-1].join(heavy, "key", "left_semi"), width, gram, k), "runs"))
    distinct = functools.reduce(DataFrame.unionByName, distinct)
    n_shards = max(shuffle_parts(spark), -(-distinct.count() // SHARD))
    shards = distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int"))
    found = stash(repeated_windows(shards.select("shard", "id1", "id2", "run", "doc_id"), width), "windows")
    least = F.expr("filter(transform(least, (x, i) -> if(x < doc_id, start + i, null)), x -> x is not null)")
    places = functools.reduce(DataFrame.unionByName, (r.select("id1", "id2", *one, "start") for r in runs))
    gone = places.join(found, ["id1", "id2"]).select(*one, least.alias("at")).where("size(at) > 0")
    gone = stash(gone.groupBy(*one).agg(F.flatten(F.collect_list("at")).alias("gone")), "gone")
    spans = places.join(copied, one, "left_semi").join(found, ["id1", "id2"])  # of all windows, as they are a document's of copies
    spans = spans.groupBy(F.col("doc_id").alias("first_id"), F.col("of").alias("first_of")).agg(F.min("start").alias("low"), F.max(F.col("start") + F.size("least")).alias("high"), F.max(F.array_max("least")).alias("last"))
    spans = stash(spans, "spans")
    discard(*runs, found)
    same = copies.join(spans, ["first_id", "first_of"]).where("last < doc_id").select(*one, F.lit(None).cast("array<bigint>").alias("gone"), "low", "high")
    none = F.lit(None).cast("bigint")
    told = gone.join(copies, one, "left_anti").select(*one, "gone", none.alias("low"), none.alias("high")).unionByName(same)
    return keep_words(rows_of(docs).join(told, one, "left").select("doc_id", "text", "low", "high", "gone"), width)


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s),
g AS (SELECT DISTINCT doc_id, p FROM (SELECT x.doc_id, unnest(range(i, i + 13)) AS p FROM x JOIN f USING (s) WHERE first < x.doc_id)),
r AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(list_transform(w, lambda v, i: CASE WHEN list_contains(ps, i) THEN NULL ELSE v END), lambda v: v IS NOT NULL), ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
