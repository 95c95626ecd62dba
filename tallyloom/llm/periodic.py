"""Maximal periodic runs of words within each text, and the texts with each run's repetitions taken out.

Harmonic grid: a run of period p and a length of three periods or more holds three multiples of p in a row at least, so
for each p only the pairs jp, (j+1)p of the grid are asked how far the text agrees p words apart, to the right and to
the left; over all p that is n ln n pairs. Pairs whose words, or whose next pair's words, differ can't be in such a run
and aren't asked. The answers are longest common extensions: the least of a range of the LCP array between two
suffixes' places in the suffix array, for the right those of the words, for the left those of the reversed words.
The texts of a block are put behind one another, the longest first, each ended by a symbol of its own. All arrays are a
few numbers a word long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, fold, slices, texts
from .wordhash import hashes, spans, text_bytes

FAR = np.int32(2**31 - 1)
#: Grid pairs that are asked at a time.
ASKED = 1 << 18


def symbols(h: np.ndarray) -> np.ndarray:
    """Small numbers for words by both of their hashes."""
    values, at, where = np.unique(h[0], return_index=True, return_inverse=True)
    if (h[1][at][where] == h[1]).all():
        return where.astype(np.int32)
    order = np.lexsort(h)  # different words share the first hash
    changed = (h[:, order[1:]] != h[:, order[:-1]]).any(0)
    out = np.zeros(h.shape[1], np.int32)
    out[order[1:]] = np.cumsum(changed)
    return out


def minima(x: np.ndarray) -> list[np.ndarray]:
    """x, the least of each two of it, of each four, and so on."""
    levels = [x]
    while len(x) > 1:
        if len(x) % 2:
            x = np.append(x, FAR)
        x = np.minimum(x[::2], x[1::2])
        levels.append(x)
    return levels


def least(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of x[first..last] for each pair of places."""
    out, a, b = np.full(len(first), FAR), first.astype(np.int64), last.astype(np.int64) + 1
    for x in levels:
        take = np.flatnonzero((a < b) & (a % 2 == 1))
        out[take] = np.minimum(out[take], x[a[take]])
        a[take] += 1
        take = np.flatnonzero((a < b) & (b % 2 == 1))
        b[take] -= 1
        out[take] = np.minimum(out[take], x[b[take]])
        a //= 2
        b //= 2
        if not (a < b).any():
            break
    return out


class Suffixes:
    """Suffix array of symbols by doubling, with LCP array and range minima.

    Suffixes that agree in k symbols are one class, named by its first place. A step sorts the classes of several members
    by what follows after k symbols. Where a class divides, two neighbours agree in k symbols and as many more as the
    suffixes k further on, whose classes were divided in an earlier step.
    """

    def __init__(self, s: np.ndarray) -> None:
        n = len(s)
        order = np.argsort(s, kind="stable")
        lcp = np.full(n, FAR)
        lcp[:1] = 0
        lcp[1:][s[order[1:]] != s[order[:-1]]] = 0
        rank = np.empty(n, np.int32)
        places, k = np.arange(n), 1
        rank[order] = np.maximum.accumulate(np.where(lcp == 0, places, 0))
        while True:
            inside = lcp == FAR
            open_ = inside.copy()
            open_[:-1] |= inside[1:]
            at = np.flatnonzero(open_)
            if not len(at):
                break
            levels = minima(lcp)
            here = order[at]
            after = here + k
            second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            moved = np.argsort(rank[here].astype(np.int64) * (n + 1) + second, kind="stable")
            here, second = here[moved], second[moved]
            order[at] = here
            split = np.flatnonzero(inside[at[1:]] & (second[1:] != second[:-1])) + 1
            one, two = np.minimum(second[split], second[split - 1]) - 1, np.maximum(second[split], second[split - 1]) - 1
            lcp = lcp.copy()
            lcp[at[split]] = k + np.where(one < 0, 0, least(levels, np.maximum(one, 0) + 1, two))
            rank[order[at]] = np.maximum.accumulate(np.where(lcp != FAR, places, 0))[at]
            k *= 2
        self.rank, self.levels = rank, minima(lcp)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at i and j, different places, agree in."""
        a, b = self.rank[i], self.rank[j]
        return least(self.levels, np.minimum(a, b) + 1, np.maximum(a, b))


def grid(s: np.ndarray, ends: np.ndarray, lengths: np.ndarray, shortest: int):
    """(place jp, period p) of the grid pairs to ask, in arrays. Texts come the longest first; ends: where each ends."""
    within = lambda p: int(ends[k - 1]) if (k := int(np.searchsorted(-lengths, -max(shortest, 3 * p), side="right"))) else 0
    most = int(lengths[0]) // 3 if len(lengths) else 0
    few = min(most, int(within(1) ** 0.5) + 1)
    for p in range(1, few + 1):
        x = s[: within(p) : p]
        same = x[1:] == x[:-1]
        j = np.flatnonzero(same[1:] & same[:-1])
        if len(j):
            yield j * p, np.full(len(j), p)
    # the longer periods by j, as these have few multiples
    total = within(few + 1) if few < most else 0
    for j in range(total // (few + 1) - 1):
        last = min(most, (total - 1) // (j + 2))
        x, y, z = (s[k * (few + 1) : k * last + 1 : k] if k else s[:1] for k in (j, j + 1, j + 2))
        p = np.flatnonzero((x == y) & (y == z)) + few + 1
        if len(p):
            yield j * p, p


def asked(s: np.ndarray, starts: np.ndarray, lengths: np.ndarray, shortest: int):
    """The pairs of the grid whose three words lie in one text."""
    text_of = np.repeat(np.arange(len(starts)), lengths + 1)
    for i, p in grid(s, starts + lengths + 1, lengths, shortest):
        ok = i + 2 * p < len(s)
        ok[ok] = text_of[i[ok]] == text_of[i[ok] + 2 * p[ok]]
        if ok.any():
            yield i[ok], p[ok]


class Found:
    """The runs that pairs lie in, and for each word one long run that holds it.

    A pair of period p inside a run whose period divides p is in that run or in none of three periods of p, so it isn't
    asked again.
    """

    def __init__(self, s: np.ndarray, shortest: int) -> None:
        self.right, self.left, self.n, self.shortest = Suffixes(s), Suffixes(s[::-1]), len(s), shortest
        self.rows = np.zeros((0, 3), np.int64)
        self.period, self.inside = np.ones(1, np.int64), np.zeros(self.n, np.int32)

    def new(self, i: np.ndarray, p: np.ndarray) -> np.ndarray:
        at = self.inside[i]
        return np.flatnonzero((at == 0) | (at != self.inside[i + 2 * p]) | (p % self.period[at] != 0))

    def ask(self, i: np.ndarray, p: np.ndarray) -> None:
        for at in range(0, len(i), ASKED):
            a, q = i[at : at + ASKED], p[at : at + ASKED]
            ahead, back = self.right.common(a, a + q).astype(np.int64), np.zeros(len(a), np.int64)
            inner = np.flatnonzero(a > 0)
            back[inner] = self.left.common(self.n - a[inner], self.n - a[inner] - q[inner])
            length = q + ahead + back
            ok = length >= np.maximum(self.shortest, 3 * q)
            found = np.unique(np.stack([a - back, length, q], 1)[ok], axis=0)
            self.rows = np.concatenate([self.rows, found])
            for start, size, q in found[found[:, 1] >= 8 * found[:, 2]].tolist():
                if self.inside[start] == 0 or self.inside[start] != self.inside[start + size - 1] or q % self.period[self.inside[start]]:
                    self.inside[start : start + size] = len(self.period)
                    self.period = np.append(self.period, q)

    def add(self, i: np.ndarray, p: np.ndarray) -> None:
        some = self.new(i, p)
        i, p = i[some], p[some]
        head = np.ones(len(i), bool)
        head[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1] + p[1:])
        self.ask(i[head], p[head])
        i, p = i[~head], p[~head]
        some = self.new(i, p)
        self.ask(i[some], p[some])


def runs(s: np.ndarray, starts: np.ndarray, lengths: np.ndarray, shortest: int = 24) -> tuple[np.ndarray, ...]:
    """(text, first word, length, period) of the runs, by text, start and period. s: symbols of texts put behind one
    another, so that a text's words are s[starts[k] : starts[k] + lengths[k]] and the symbol after them is its own."""
    some = np.zeros(len(starts), bool)
    for i, _ in asked(s, starts, lengths, shortest):
        some[np.searchsorted(starts, i, side="right") - 1] = True
    if not some.any():
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    # texts without such pairs have no runs
    s, lengths = s[np.repeat(some, lengths + 1)], lengths[some]
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    found, held, n = Found(s, shortest), [], 0
    for i, p in asked(s, starts, lengths, shortest):
        held.append((i, p))
        n += len(i)
        if n >= ASKED:
            found.add(*(np.concatenate(x) for x in zip(*held)))
            held, n = [], 0
    if held:
        found.add(*(np.concatenate(x) for x in zip(*held)))
    rows = np.unique(found.rows, axis=0)
    # the same stretch at a multiple of its period comes after it
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[first]
    text = np.searchsorted(starts, rows[:, 0], side="right") - 1
    out = np.stack([np.flatnonzero(some)[text], rows[:, 0] - starts[text], rows[:, 1], rows[:, 2]])
    return tuple(out[:, np.lexsort((out[3], out[1], out[0]))])


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.Array:
    """The words of each text with one space between them. first: first word of each text and the end."""
    size = ends - starts + 1
    to = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(to[-1]) + np.repeat(starts - to[:-1], size)
    out = np.append(data, np.uint8(32))[np.minimum(at, len(data))]
    out[to[1:] - 1] = 32
    keep = np.ones(len(out), bool)
    texts_to = to[first]
    last = texts_to[1:][texts_to[1:] > texts_to[:-1]] - 1  # no space behind a text
    keep[last] = False
    gone = np.concatenate([[0], np.cumsum(texts_to[1:] > texts_to[:-1])])
    offsets = (texts_to - gone).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(out[keep].tobytes()))


def described(column: pa.Array, shortest: int) -> tuple:
    """n_words, offsets into the runs, their (start, length, period), and the collapsed texts."""
    data, offsets = text_bytes(column)
    starts, ends, first = spans(data, offsets)
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] >= shortest]
    sizes = lengths[order]
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    ids = symbols(hashes(data, starts, ends)) if len(order) else np.zeros(0, np.int32)
    s = np.empty(bounds[-1], np.int32)
    for k, text in enumerate(order):
        s[bounds[k] : bounds[k + 1] - 1] = ids[first[text] : first[text + 1]]
        s[bounds[k + 1] - 1] = len(ids) + k
    text, start, length, period = runs(s, bounds[:-1], sizes, shortest)
    text = order[text]
    by = np.lexsort((period, start, text))
    text, start, length, period = text[by], start[by], length[by], period[by]
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, first[text] + start + period, 1)
    np.add.at(change, first[text] + start + length, -1)
    keep = np.cumsum(change)[:-1] == 0
    at = np.concatenate([[0], np.cumsum(keep)])[first]
    return lengths, np.searchsorted(text, np.arange(len(lengths) + 1)), (start, length, period), joined(data, starts[keep], ends[keep], at)


RUN = "struct<start: long, length: long, period: long>"


def periodic_runs(docs: DataFrame, shortest: int = 24) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (array of start, length, period, by start, then period), collapsed.

    Words are the longest runs of anything but the six white-space characters. A run is a stretch of consecutive words
    whose smallest period is q (words q apart are identical), of max(shortest, 3 * q) words at least, that no neighbouring
    word extends keeping that period; shortest is 3 at least. collapsed has the text's words, joined by one space,
    without those that a run holds after its first q words. A null or blank text has no words, no runs and an empty
    collapsed text; rows that repeat a doc_id, or have none, are rows of their own; no rows in, no rows out. Other columns
    of docs don't matter. Words are compared by 128 bits. A text is worked on whole: about 100 bytes of memory a word, for
    texts that have runs.
    """
    if shortest < 3:
        raise ValueError("shortest must be 3 at least")

    def apply(batches):
        for b in slices(batches):
            n, at, found, collapsed = described(b.column("text"), shortest)
            each = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), each), collapsed.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return texts(docs).mapInArrow(apply, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def strongest(found: Column) -> Column:
    """The run with the greatest length / period, of equal ones the first; null if there is none."""
    greater = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(found, F.lit(None).cast(RUN), lambda best, r: F.when(greater(best, r), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which one document of ten gets a run: with h the crc32 of its doc_id and g = h div 10, each
    word from a = g % n on becomes word a + (i - a) % p, where p = 1 + (n - a) div (3 + g % 8). A null doc_id gets none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", f"[{SPACES}]+", -1), lambda w: w != "")
    rows = texts(docs).withColumn("words", F.when(fold(F.col("doc_id"), 10) == 0, words)).withColumn("g", F.floor(h / 10).cast("long"))
    n = F.size("words").cast("long")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n))
    rows = rows.withColumn("p", F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("long") + 1)
    moved = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.col("words")[F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")])
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The columns of op13 of what periodic_runs returns."""
    line = F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.sha2(line.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
