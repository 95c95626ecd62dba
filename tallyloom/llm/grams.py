"""Character n-grams of words as hashed feature numbers, and a small logistic regression."""

from __future__ import annotations

import numpy as np

MUL = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Entries of a matrix that are gone through at once.
ENTRIES = 1 << 18
#: Words that are scored at once.
PIECE = 4_000


def grams(words: list[str], low: int, high: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, number of the word) of each n-gram, low <= n <= high, of the words between a start and an end mark."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    h, features, numbers = np.zeros(len(chars), np.uint64), [], []
    for n in range(1, high + 1):
        if n > len(chars):
            break
        h = h[: len(chars) - n + 1] * MUL + chars[n - 1 :] + np.uint64(1)
        if n >= low:
            whole = of[: len(h)] == of[n - 1 :]
            x = h[whole] * MIX
            x = (x ^ (x >> np.uint64(29))) * MUL
            features.append((x >> np.uint64(64 - bits)).astype(np.int64))
            numbers.append(of[: len(h)][whole])
    return np.concatenate(features), np.concatenate(numbers)


class Memo(dict):
    """Scores of words; a worker keeps at most `keep` of them."""

    def __init__(self, score, keep: int = 300_000):
        self.score, self.keep = score, keep

    def meet(self, docs: list) -> None:
        """Scores the words that are new, all at once."""
        new = list({w for words in docs for w in words if w not in self})
        if len(self) + len(new) > self.keep:
            self.clear()
            new = list({w for words in docs for w in words})
        for k in range(0, len(new), PIECE):
            self.update(zip(new[k : k + PIECE], self.score(new[k : k + PIECE])))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, l2: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-penalised logistic regression over a sparse matrix given by entries, by L-BFGS."""
    n = len(y)
    pieces = [slice(k, k + ENTRIES) for k in range(0, len(values), ENTRIES)]

    def loss(p):
        z, g = np.zeros(n), np.zeros(width)
        for k in pieces:
            np.add.at(z, rows[k], values[k] * p[cols[k]])
        z += p[-1]
        q = logistic(z)
        for k in pieces:
            np.add.at(g, cols[k], values[k] * (q - y)[rows[k]])
        g = np.append(g / n + l2 * p[:-1], (q - y).mean())
        return float(np.logaddexp(0, np.where(y > 0, -z, z)).mean() + l2 / 2 * (p[:-1] @ p[:-1])), g

    p = np.zeros(width + 1)
    f, g = loss(p)
    pairs: list = []
    for _ in range(rounds):
        d, alphas = -g, []
        for s, t, r in reversed(pairs):
            alphas.append(a := r * (s @ d))
            d = d - a * t
        if pairs:
            s, t, r = pairs[-1]
            d = d * (1 / (r * (t @ t)))
        for (s, t, r), a in zip(pairs, reversed(alphas)):
            d = d + s * (a - r * (t @ d))
        step = 1.0 if pairs else min(1.0, 1 / (np.abs(g).sum() + 1e-12))
        while True:
            new_f, new_g = loss(p + step * d)
            if new_f <= f + 1e-4 * step * (g @ d) or step < 1e-8:
                break
            step /= 2
        s, t = step * d, new_g - g
        if s @ t > 1e-12:
            pairs = [*pairs[-9:], (s, t, 1 / (s @ t))]
        p, done = p + s, f - new_f < 1e-7 * max(1, abs(f))
        f, g = new_f, new_g
        if done:
            break
    return p[:-1], float(p[-1])
