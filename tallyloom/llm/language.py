"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the hashed n-grams of a text's words; a feature's value is its share of the text's n-grams times its
inverse document frequency among the training texts. The weights are learned by follow-the-regularised-leader with
elastic-net penalties, which leaves most of them at nought, and the softmax gets a temperature fitted on training
rows that were set aside. As shares add up over words, a distinct word is scored once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import Memo, grams
from .shared import slices, texts
from .toxicity import TEXT_BYTES, fitted

LOW, HIGH, BITS = 1, 4, 18
#: Rows that the classifier is fitted on, at most.
SAMPLE = 6_000
SCALE = 20.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
EPOCHS = 3
LETTER = regex.compile(r"\p{L}")
NONE = "und"


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    f, n = np.unique(grams(text.lower().split(), LOW, HIGH, BITS)[0], return_counts=True)
    return f.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def train(values: list[str], labels: list[str]) -> dict:
    """A model from texts and language names. A text without a letter isn't learned from."""
    pairs = [(features(t), y) for t, y in zip(values, labels) if LETTER.search(t)]
    names = sorted({y for _, y in pairs})
    model = {"names": names, "keys": np.zeros(0, np.int64), "weights": np.zeros((0, len(names))), "bias": np.zeros(len(names)), "temperature": 1.0}
    if len(names) < 2:
        return model
    df = np.zeros(1 << BITS)
    for (f, _), _ in pairs:
        df[f] += 1
    idf = np.log((1 + len(pairs)) / (1 + df)) + 1
    c, y = len(names), np.array([names.index(y) for _, y in pairs])
    aside = np.arange(len(pairs)) % 5 == 4
    z, s = np.zeros((1 << BITS, c)), np.zeros((1 << BITS, c))
    bias = np.zeros(c)
    order = np.random.default_rng(7).permutation(np.flatnonzero(~aside))
    for _ in range(EPOCHS):
        for i in order:
            f, tf = pairs[i][0]
            x = SCALE * tf * idf[f]
            zf, sf = z[f], s[f]
            wf = np.where(np.abs(zf) <= L1, 0.0, -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(sf)) / ALPHA + L2))
            q = softmax(x @ wf + bias)
            q[y[i]] -= 1
            g = x[:, None] * q
            z[f] = zf + g - (np.sqrt(sf + g * g) - np.sqrt(sf)) / ALPHA * wf
            s[f] = sf + g * g
            bias -= 0.02 * q
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(s)) / ALPHA + L2))
    held = np.flatnonzero(aside)
    if len(held):
        logits = np.array([SCALE * (pairs[i][0][1] * idf[pairs[i][0][0]]) @ w[pairs[i][0][0]] + bias for i in held])
        grid = np.geomspace(0.2, 10, 80)
        nll = [-np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
        model["temperature"] = float(grid[int(np.argmin(nll))])
    keys = np.flatnonzero(np.abs(w).sum(1))
    return model | {"keys": keys, "weights": (SCALE * idf[:, None] * w)[keys], "bias": bias}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def scorer(model: dict):
    c = len(model["names"])
    table = np.zeros((1 << BITS, c))
    table[model["keys"]] = model["weights"]

    room = np.zeros((1 << 16, c + 1), np.float32)  # a word's summed weights and its number of n-grams

    def score(words: list[str]) -> range:
        nonlocal room
        f, of = grams(words, LOW, HIGH, BITS)
        first = len(memo)
        while first + len(words) > len(room):
            room = np.concatenate([room, np.zeros_like(room)])
        for k in range(c):
            room[first : first + len(words), k] = np.bincount(of, table[f, k], minlength=len(words))
        room[first : first + len(words), c] = np.bincount(of, minlength=len(words))
        return range(first, first + len(words))

    memo = Memo(score, keep=300_000)

    def apply(values: list[str]) -> tuple[list[str], np.ndarray]:
        lists = [t.lower().split() if c and LETTER.search(t) else [] for t in values]
        memo.meet([set(x) for x in lists])
        names, scores = [], np.zeros(len(values))
        for i, words in enumerate(lists):
            if not words:
                names.append(NONE)
                continue
            total = room[list(map(memo.__getitem__, words))].sum(0, dtype=np.float64)
            q = softmax((total[:c] / total[c] + model["bias"]) / model["temperature"])
            names.append(model["names"][int(q.argmax())])
            scores[i] = q.max()
        return names, scores

    return apply


def fit(docs: DataFrame, labelled: DataFrame, label: str = "lang", sample: int = SAMPLE, most: int = TEXT_BYTES) -> dict:
    """A model of at most `sample` labelled rows, and of about `most` bytes of text."""
    return fitted(labelled, docs, label, train, sample, most)


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (the calibrated probability of lang_pred).

    A null text, or one without a letter, is `und` with score 0; so is every text if no language was learned. Equal
    probabilities: the first name by code point. Repeated rows get the same answer each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        score = scorer(shared.value)
        for b in slices(batches):
            names, s = score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(s, pa.float64())], ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(apply, "doc_id long, lang_pred string, score double")
