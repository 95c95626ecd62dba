"""Near-duplicate components of documents by similarity sketches, banding and exact verification.

1. Each text's set of word n-grams gets a sketch of T = BANDS * ROWS coordinates. In round i < T every n-gram is thrown
   into a bin by a hash of that round, in round T + b every n-gram into bin b; a bin keeps the least hash of the first
   round that meets it. So every coordinate is filled after 2 * T rounds, large sets are done after one or two, and the
   coordinates in which two sketches agree are concentrated about the sets' Jaccard similarity like independent draws.
2. Sets that agree in all ROWS coordinates of a band share a tile. A pair of similarity s shares none with a probability of
   (1 - s ** ROWS) ** BANDS: 1.3e-7 at 0.8, 6e-11 at 0.85.
3. Tiles are decided as those of the n-gram join: leaders, components, pairs in bounded blocks, bitmaps first, and each
   link confirmed on the full sets. No tile is capped; a hot one is divided by the n-grams that linked sets must share
   where that leaves fewer pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import component_ids, describe, linked
from .wordhash import mix, mix_other

BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
SEED = np.uint64(0xA0761D6478BD642F)
#: N-grams thrown at a time, so that a long text's hashes aren't all held at once.
THROWN = 1 << 18


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES hashes for each of the sets of hashes, none of them empty."""
    t, sizes = COORDINATES, np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), t), np.uint64)
    filled = np.zeros((len(sets), t), bool)
    flat, ends = (np.concatenate(sets), np.cumsum(sizes)) if sets else (np.zeros(0, np.uint64), sizes)
    starts, open_ = ends - sizes, np.arange(len(sets))
    for i in range(2 * t):
        if not len(open_):
            break
        seed = mix(np.array([i], np.uint64) ^ SEED)
        owner = np.repeat(open_, sizes[open_])
        item = np.arange(len(owner)) + np.repeat(starts[open_] - np.concatenate([[0], np.cumsum(sizes[open_])[:-1]]), sizes[open_])
        slots, values = [], []
        for at in range(0, len(owner), THROWN):
            h = mix(flat[item[at : at + THROWN]] ^ seed)
            bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
            slot = owner[at : at + THROWN] * t + bins
            new = ~filled.ravel()[slot]
            slots.append(slot[new])
            values.append(mix_other(h[new]))
        slot, value = np.concatenate(slots), np.concatenate(values)
        order = np.lexsort((value, slot))
        slot, value = slot[order], value[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        out.ravel()[slot[first]], filled.ravel()[slot[first]] = value[first] ^ seed, True
        open_ = open_[~filled[open_].all(1)]
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    """A hash of each band and its number, by rows of sketches."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    out = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64) + SEED), (len(sketch), BANDS))
    for k in range(ROWS):
        out = mix_other(mix(out ^ parts[:, :, k]))
    return out


def by_bands(docs: DataFrame, width: int, share: int) -> tuple:
    return describe(docs, width, lambda sets: list(bands(sketches(sets)))), None


def near_duplicates(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (size of its set), component_id, kept (doc_id = component_id).

    The set has the distinct n-grams of `width` words of the text with A-Z in lower case; with fewer words the whole
    sequence is one n-gram, and without words, or with a null text, the set is empty and linked with nothing. Documents
    are linked when 100 * intersection >= share * union, confirmed on the full sets; share is 80 to 100, as bands are
    made for that. component_id is the smallest doc_id reachable by links, the document's own included; a null doc_id is
    never the smallest, and a row with one is kept if it is linked with no other. Rows that repeat a doc_id are rows of
    their own: equal ones are all kept or all not. No rows in, no rows out. Other columns of docs don't matter. Equal sets
    are one class, so that no group of copies is expanded.
    """
    if not 80 <= share <= 100:
        raise ValueError("share must be 80 to 100")
    found = component_ids(*linked(docs, width, share, by_bands))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * same >= 80 * (m.n + o.n - same)),
r AS (SELECT a AS doc_id, b AS root FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.root = l.a),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.root, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.root, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
