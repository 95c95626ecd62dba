"""Packing of token pieces into sequences of fixed length: shortest pack first over the histogram of lengths.

1. Texts become ids word by word, with the ids of words met before kept by the worker; a document's ids and its end id are
   cut at multiples of the sequence length, so that only the last piece is shorter. Only lengths and checksums leave
   this stage.
2. The histogram of piece lengths (at most `most` rows, whatever the input) goes to the driver. Lengths are placed
   longest first into the open pattern with the most room; patterns carry counts, and a pattern is split when only
   some of its copies are filled. So the work depends on the number of lengths, not of documents.
3. Each piece gets its rank among the pieces of its length: counts by (length, salt) are summed up over the salts,
   and rows are numbered within a salt. A pattern's slot holds a range of ranks, which gives the sequence.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept, shuffle_parts, slices, stash, texts

WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
UNUSUAL = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeİ]|[^\x00-ſ‐-‧‰-⁞€]")
#: Distinct words whose ids a worker keeps, at least; twice as many at most.
KEEP = 200_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

_loaded: dict[str, tuple] = kept.setdefault("packing", {})


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Recent(dict):
    """A table that makes what it lacks and keeps the last KEEP to 2 * KEEP entries."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= KEEP:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def load(path: str):
    """The library's tokenizer, its special tokens' pattern, and ids by what stands between white space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _loaded:
        tok = Tokenizer.from_file(path)
        special = re.compile("|".join(re.escape(t.content) for t in tok.get_added_tokens_decoder().values()) or r"(?!)")
        model, letters = tok.model, byte_letters()

        def make(token: str) -> bytes:
            parts = WORD.findall(token)
            if len(parts) > 1:
                return b"".join(map(known.__getitem__, parts))
            if not (token.isascii() and token.isprintable()):
                token = token.encode().decode("latin-1").translate(letters)
            return np.array([t.id for t in model.tokenize(token)], "<u4").tobytes()

        known = Recent(make)
        _loaded[path] = tok, special, known
    return _loaded[path]


def unusual(text: str) -> bool:
    """Whether a text has characters on which re and the library may differ; it's then left to the library as a whole."""
    if text.isascii():
        return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
    return UNUSUAL.search(text) is not None


def ids_of(values: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    tok, special, known = load(path)
    whole = lambda t: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    return [whole(t) if unusual(t) or special.search(t) else b"".join(map(known.__getitem__, t.lower().split())) for t in values]


def pieces_of(docs: DataFrame, tokenizer_path: str, most: int, end_id: int, with_ids: bool = False) -> DataFrame:
    def cut(batches):
        end = np.array([end_id], "<u4").tobytes()
        for b in slices(batches, owner="packing"):
            rows, parts = [[], [], [], [], []], []
            for doc, ids in zip(b.column("doc_id").to_pylist(), ids_of(b.column("text").to_pylist(), tokenizer_path)):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, most):
                    part = ids[4 * s : 4 * (s + most)]
                    for to, x in zip(rows, (doc, s, len(part) // 4, zlib.crc32(part), n)):
                        to.append(x)
                    if with_ids:
                        parts.append(part)
            more = [pa.array(parts, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays([*(pa.array(r, pa.int64()) for r in rows), *more], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids])

    return texts(docs).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def plan(histogram: dict[int, int], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Slots, ordered by (length, first rank): length, first rank, first sequence, offset; and the number of sequences.

    Longest lengths first; each goes to the open pattern with the most room (the shortest pack), if it fits there,
    and else opens a pattern of its own.
    """
    room: dict[int, list] = defaultdict(list)  # room left -> [copies, [(length, first rank), ...]]
    done = []
    left = 0  # no pattern has more room than this
    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        while n:
            while left and not room.get(left):
                left -= 1
            if left >= length:
                copies, items = room[left].pop()
                free = left - length
                if copies > n:
                    room[left].append([copies - n, [(k, r + n) for k, r in items]])
                    copies = n
                new = [(copies, [*items, (length, rank)], free)]
                n -= copies
                rank += copies
            else:  # nothing has room: new patterns, each with as many as fit, and one with what is left
                fit = most // length
                full, over = divmod(n, fit)
                new = [(full, [(length, rank + i * full) for i in range(fit)], most - fit * length)] if full else []
                rank += full * fit
                if over:
                    new.append((1, [(length, rank + i) for i in range(over)], most - over * length))
                n = 0
            for copies, items, free in new:
                if free:
                    room[free].append([copies, items])
                    left = max(left, free)
                else:
                    done.append([copies, items])
    done += [p for packs in room.values() for p in packs]
    slots, sequence = [], 0
    for copies, items in done:
        offset = 0
        for length, rank in items:
            slots.append((length, rank, sequence, offset))
            offset += length
        sequence += copies
    slots.sort()
    at = np.array(slots, np.int64).reshape(-1, 4).T.copy()
    return at[0], at[1], at[2], at[3], sequence


def pack(docs: DataFrame, tokenizer_path: str, most: int = 2048, end_id: int = 1, salts: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Long documents are cut at multiples of `most`. Repeated rows are packed
    each. No rows in, no rows out. Pieces of one length are ranked by (salt, doc_id, start), the checksum breaking
    ties, so that reruns agree. `salts` (shuffle partitions, 64 at least) splits the pieces of one length.
    """
    spark = docs.sparkSession
    salts = salts or max(64, shuffle_parts(spark))
    pieces = pieces_of(docs, tokenizer_path, most, end_id)
    pieces = stash(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int")), "pieces")
    counts = stash(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length, `most` at most
    slots = spark.sparkContext.broadcast(plan(histogram, most)[:4])
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(firsts, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("first")).cast("long").alias("rank"))

    def place(batches):
        lengths, ranks, sequences, offsets = slots.value
        edges = np.searchsorted(lengths, np.arange(most + 2))
        wide = int(ranks.max(initial=0)) + 1  # length and rank as one number, where that has room
        keys = lengths * wide + ranks if wide < 2**50 else None
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            if keys is not None:
                k = np.searchsorted(keys, n * wide + np.minimum(r, wide - 1), "right") - 1
            else:
                k = np.array([edges[x] + np.searchsorted(ranks[edges[x] : edges[x + 1]], y, "right") - 1 for x, y in zip(n, r)], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequences[k] + r - ranks[k]), pa.array(offsets[k])], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, most: int = 2048, end_id: int = 1, pad_id: int = 0) -> DataFrame:
    """The sequences of pack() themselves: sequence_id, ids (array of int), used (without padding).

    Ids are padded with pad_id to `most`, except where their number is a power of two.
    """
    key = ["doc_id", "start", "ids_crc32"]
    ids = pieces_of(docs, tokenizer_path, most, end_id, with_ids=True).dropDuplicates(key).select(*(F.col(c).alias("_" + c) for c in key), "ids")
    same = packed["doc_id"].eqNullSafe(ids["_doc_id"]) & (packed["start"] == ids["_start"]) & (packed["ids_crc32"] == ids["_ids_crc32"])
    whole = packed.join(ids, same).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))  # most ids at most

    def join(batches):
        for b in batches:
            out, used = [], []
            for pieces in b.column("pieces").to_pylist():
                x = np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").astype(np.int32)
                used.append(len(x))
                out.append(x if len(x) & (len(x) - 1) == 0 else np.pad(x, (0, most - len(x)), constant_values=pad_id))
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), pa.array(out, pa.list_(pa.int32())), pa.array(used, pa.int32())], ["sequence_id", "ids", "used"])

    return whole.mapInArrow(join, "sequence_id long, ids array<int>, used int")
