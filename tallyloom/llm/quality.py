"""Document quality from a linear-chain conditional random field over lines.

Each line gets a label, good or bad. Its features are counts and shares of its characters and words, cut into
quantile bins, of the line itself, of the line before and of the line after. Training starts from the documents'
labels on all their lines; lines of bad documents that the field then holds for good are relabelled, and the field is
fitted again. A document's badness is the mean of its lines' forward-backward marginals, weighted by the lines'
lengths; a logistic curve fitted on the training documents turns it into the score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .grams import fit_logistic, logistic
from .shared import slices, texts
from .toxicity import TEXT_BYTES, fitted

#: Rows that the field is fitted on, at most.
SAMPLE = 6_000
#: Bins of a feature, at most: their edges are quantiles over all lines and over the lines of bad documents.
BINS = 16
#: Lines that are gone through one by one, in all documents at once; blocks of so many are then joined by their transfer
#: matrices, so that a document is one chain whatever its length.
BLOCK = 48
#: Bytes whose kinds are counted at a time, and the length from which a line's words are taken one by one.
PIECE = 1 << 20
ROUNDS = 2

LETTER_LOW, LETTER_UP, DIGIT, SPACE, STOP, BAR, OTHER, HIGH_BYTE = range(8)
KINDS = np.full(256, OTHER, np.int64)
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[128:] = LETTER_LOW, LETTER_UP, DIGIT, HIGH_BYTE
KINDS[[32, 9, 10, 11, 12, 13]], KINDS[[46, 44, 59, 58, 63]], KINDS[124] = SPACE, STOP, BAR
N_FEATURES = 12


def kinds_of(raw: list[bytes], size: np.ndarray) -> np.ndarray:
    """How many bytes of each kind each line has."""
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size)
    out = np.zeros((len(raw), 8))
    for a in range(0, len(data), PIECE):
        z = min(a + PIECE, len(data))
        first, last = np.searchsorted(ends, [a, z - 1], "right")
        here = slice(first, last + 1)
        of = np.repeat(np.arange(last + 1 - first), np.minimum(ends[here], z) - np.maximum(ends[here] - size[here], a))
        out[here] += np.bincount(of * 8 + KINDS[data[a:z]], minlength=8 * (last + 1 - first)).reshape(-1, 8)
    return out


def line_features(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, length of each line in bytes and one, number of lines of each text)."""
    lines, counts = [], []
    for t in values:
        own = t.split("\n")
        lines += own
        counts.append(len(own))
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    kinds = kinds_of(raw, size)
    words, unique, most, same = np.zeros((4, len(raw)))
    before = None
    for i, x in enumerate(raw):
        if len(x) < PIECE:
            w = x.split()
            words[i] = len(w)
            unique[i] = len(set(w))
            most[i] = max(map(len, w), default=0)
        else:
            distinct = set()
            for m in re.finditer(rb"[^ \t-\r]+", x):
                distinct.add(m.group())
                words[i] += 1
            unique[i] = len(distinct)
            most[i] = max(map(len, distinct), default=0)
        same[i] = x == before
        before = x
    total = np.maximum(size, 1)
    letters = np.maximum(kinds[:, LETTER_LOW] + kinds[:, LETTER_UP] + kinds[:, HIGH_BYTE], 1)
    f = np.stack([np.log1p(size), kinds[:, LETTER_UP] / letters, kinds[:, DIGIT] / total, kinds[:, SPACE] / total, kinds[:, STOP] / total, kinds[:, BAR] / total, kinds[:, OTHER] / total, kinds[:, HIGH_BYTE] / total, unique / np.maximum(words, 1), np.log1p(words), most, same], 1)
    return f, size + 1.0, np.array(counts, np.int64)


def cells(f: np.ndarray, counts: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Numbers of the indicator features that are on in each line: own, before, after, and at the document's ends."""
    own = np.stack([np.searchsorted(e, f[:, k], "right") + k * BINS for k, e in enumerate(edges)], 1)
    width = N_FEATURES * BINS
    ends = np.cumsum(counts)
    first, last = np.zeros(len(f), bool), np.zeros(len(f), bool)
    first[ends - counts], last[ends - 1] = True, True
    before, after = np.roll(own, 1, 0) + width, np.roll(own, -1, 0) + 2 * width
    before[first], after[last] = 3 * width, 3 * width + 1
    return np.concatenate([own, before, after], 1)


def marginals(e: np.ndarray, counts: np.ndarray, a: np.ndarray) -> np.ndarray:
    """P(bad) of each line, by forward and backward odds. e: log odds of a line by itself; a: the transitions' logs."""
    good_good, good_bad, bad_good, bad_bad = np.exp(a).ravel().tolist()
    x = np.exp(np.clip(e, -30, 30)).tolist()
    out, at = np.empty(len(x)), 0
    for n in counts.tolist():
        back = [1.0] * n
        for t in range(at + n - 1, at, -1):
            o = x[t] * back[t - at]
            back[t - at - 1] = (bad_good + bad_bad * o) / (good_good + good_bad * o)
        o = None
        for t in range(at, at + n):
            o = x[t] if o is None else x[t] * (good_bad + bad_bad * o) / (good_good + bad_good * o)
            o = min(max(o, 1e-60), 1e60)
            p = o * back[t - at]
            out[t] = p / (1 + p)
        at += n
    return out


class Chains:
    """Documents of so many lines each, in a row, cut into blocks for forward()."""

    def __init__(self, counts: np.ndarray):
        own = -(-counts // BLOCK)
        nth = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        self.start = np.repeat(np.cumsum(counts) - counts, own) + nth * BLOCK
        self.size = np.minimum(BLOCK, np.repeat(counts, own) - nth * BLOCK)
        self.of = np.repeat(np.arange(len(nth)), self.size)  # each line's block
        self.first = nth == 0
        self.order = np.argsort(-self.size, kind="stable")
        self.alive = [int((self.size > t).sum()) for t in range(int(self.size.max()))]
        by_place = np.argsort(nth, kind="stable")
        self.later = np.split(by_place, np.cumsum(np.bincount(nth)))[1:-1]  # second blocks of documents, third ones, ...

    def forward(self, emit: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Each line's logs of sums over the labellings of the lines up to it, by its own label.

        Within its block a line's sums are made for either label before the block; the blocks' last sums are their
        transfer matrices, which give what goes into each block, and so all lines' sums.
        """
        start, lone = self.start[self.order], self.first[self.order]
        inside = np.empty((len(emit), 2, 2))  # by the label before the block, and the line's own
        k = emit[start][:, None, :]
        inside[start] = np.where(lone[:, None, None], np.stack([k[:, 0], np.full_like(k[:, 0], -1e9)], 1), a[None] + k)
        for t in range(1, len(self.alive)):
            at = start[: self.alive[t]] + t
            before = inside[at - 1]
            inside[at] = np.logaddexp(before[:, :, :1] + a[0], before[:, :, 1:] + a[1]) + emit[at][:, None, :]
        whole = inside[self.start + self.size - 1]
        into = np.zeros((len(self.start), 2))
        for b in self.later:
            into[b] = np.logaddexp(into[b - 1, :1] + whole[b - 1, 0], into[b - 1, 1:] + whole[b - 1, 1])
        into = into[self.of]
        return np.logaddexp(into[:, :1] + inside[:, 0], into[:, 1:] + inside[:, 1])


def fit_field(on: np.ndarray, counts: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the indicators and transitions of the field, by gradient ascent on the labels' likelihood (Adam)."""
    width = 3 * N_FEATURES * BINS + 2
    ahead, back = Chains(counts), Chains(counts[::-1])
    lines, ends = len(on), np.cumsum(counts)
    at = np.delete(np.arange(lines), ends - 1)  # lines with a line after them
    seen = np.bincount(y[at] * 2 + y[at + 1], minlength=4).reshape(2, 2)
    last = np.repeat(ends - 1, counts)
    p, m, v = np.zeros((3, width + 4))
    for step in range(1, rounds + 1):
        w, a = p[:width], p[width:].reshape(2, 2)
        emit = np.stack([np.zeros(lines), np.clip(w[on].sum(1), -30, 30)], 1)
        f = ahead.forward(emit, a)
        b = back.forward(emit[::-1], a.T)[::-1]  # with the line's own part
        total = np.logaddexp(f[last, 0], f[last, 1])
        q = np.exp(f[:, 1] + b[:, 1] - emit[:, 1] - total)
        ga = seen - np.exp(f[at, :, None] + a + b[at + 1, None, :] - total[at, None, None]).sum(0)
        g = np.append(np.bincount(on.ravel(), np.repeat(y - q, on.shape[1]), minlength=width), ga.ravel()) / lines - l2 * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return p[:width], p[width:].reshape(2, 2)


def badness(e: np.ndarray, size: np.ndarray, counts: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Logits of the length-weighted means of the lines' marginals."""
    at = np.cumsum(counts) - counts
    mean = np.add.reduceat(marginals(e, counts, a) * size, at) / np.add.reduceat(size, at)
    return np.log((mean + 1e-4) / (1 - mean + 1e-4))


def train(values: list[str], good: np.ndarray) -> dict:
    """A model from texts and labels (1: good). With one class only it is constant."""
    good = np.asarray(good, float)
    prior = (good.sum() + 1) / (len(good) + 2)
    model = {"edges": [np.zeros(0)] * N_FEATURES, "weights": np.zeros(3 * N_FEATURES * BINS + 2), "moves": np.zeros((2, 2)), "slope": 0.0, "bias": float(np.log(prior / (1 - prior)))}
    if not 0 < good.sum() < len(good):
        return model
    f, size, counts = line_features(values)
    bad = np.repeat((1 - good).astype(np.int64), counts)
    cuts = lambda x, n: np.quantile(x, np.arange(1, n) / n)
    edges = [np.unique(np.concatenate([cuts(f[:, k], BINS // 2), cuts(f[bad == 1, k], BINS // 2)])) for k in range(N_FEATURES)]
    on = cells(f, counts, edges)
    y = bad.copy()
    for _ in range(ROUNDS):
        w, a = fit_field(on, counts, y)
        e = w[on].sum(1)
        p = marginals(e, counts, a)
        top = np.maximum.reduceat(p, np.cumsum(counts) - counts)
        y = np.where((bad == 1) & (p < 0.3) & (p < np.repeat(top, counts)), 0, bad)
    z = badness(e, size, counts, a)
    n = len(good)
    slope, bias = fit_logistic(np.arange(n), np.zeros(n, np.int64), z, good, 1, l2=1e-6)
    return {"edges": edges, "weights": w, "moves": a, "slope": float(slope[0]), "bias": bias}


def score_texts(values: list[str], model: dict) -> np.ndarray:
    f, size, counts = line_features(values)
    e = model["weights"][cells(f, counts, model["edges"])].sum(1)
    return logistic(model["slope"] * badness(e, size, counts, model["moves"]) + model["bias"])


def fit(docs: DataFrame, labelled: DataFrame, label: str = "quality", sample: int = SAMPLE, most: int = TEXT_BYTES) -> dict:
    """A model of at most `sample` labelled rows, and of about `most` bytes of text."""
    return fitted(labelled, docs, label, lambda t, y: train(t, np.array(y, float)), sample, most)


def quality(docs: DataFrame, model: dict) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1, higher: likelier good), predicted (1 if score >= 0.5, else 0).

    Null and empty texts are one empty line, and are scored like that. Repeated rows get the same score each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        for b in slices(batches):
            s = score_texts(b.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(apply, "doc_id long, score double, predicted int")


def label_lines(docs: DataFrame, model: dict) -> DataFrame:
    """One row per line: doc_id, line (from 0), size (bytes and one), p_bad (its marginal), label (good or bad)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        m = shared.value
        for b in slices(batches):
            f, size, counts = line_features(b.column("text").to_pylist())
            p = marginals(m["weights"][cells(f, counts, m["edges"])].sum(1), counts, m["moves"])
            line = np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)
            of = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), pa.array(line), pa.array(size.astype(np.int64)), pa.array(p), pa.array(np.where(p >= 0.5, "bad", "good").tolist(), pa.string())], ["doc_id", "line", "size", "p_bad", "label"])

    return texts(docs).mapInArrow(apply, "doc_id long, line long, size long, p_bad double, label string")
