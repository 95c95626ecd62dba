"""Words and runs of words of a block of texts as arrays of hashes.

A word has two 64-bit hashes (128 bits), made by two chains of different, non-linear steps over its blocks of eight
bytes; a word of over LONG bytes has the two halves of its BLAKE2b digest. Words of at most eight bytes never collide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SEED_A, SEED_B = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
LONG = 64
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_other(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the texts in them and their end) of a string or binary column without nulls."""
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, its end, first word of each text and the end).

    A word is a longest run of anything but the six white-space characters within a text.
    """
    n = len(data)
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[:1], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1:], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two rows: both hashes of each word."""
    length = ends - starts
    out = np.stack([mix(length.astype(np.uint64) ^ SEED_A), mix_other(length.astype(np.uint64) + SEED_B)])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left, at = np.flatnonzero(length <= LONG), 0
    while len(left):
        block = blocks[starts[left] + at] & MASKS[np.minimum(length[left] - at, 8)]
        out[0, left] = mix(out[0, left] ^ block)
        out[1, left] = mix_other(out[1, left] + block)
        at += 8
        left = left[length[left] > at]
    for k in np.flatnonzero(length > LONG).tolist():
        out[:, k] = np.frombuffer(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=16).digest(), "<u8")
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(both hashes of each word, its start, its end, first word of each text and the end)."""
    if lower:
        data = LOWERED[data]
    starts, ends, first = spans(data, offsets)
    return hashes(data, starts, ends), starts, ends, first


def runs_of_words(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` words, by its first word, from both hashes of the words."""
    n = max(0, h.shape[1] - width + 1)
    out = np.full(n, SEED_A ^ np.uint64(width))
    for i in range(width):
        out = mix(out ^ h[0, i : i + n]) + h[1, i : i + n]
    return mix_other(out)
