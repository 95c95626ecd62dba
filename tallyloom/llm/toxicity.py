"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A document's features are the n-grams of its distinct words (a word being what lies between white space, in lower
case, with marks at both ends), counted by word. The log-count ratio of an n-gram compares its share of the n-grams
of toxic and of other documents; the n-grams with the largest ratio against its standard error are kept, their counts
are multiplied by their ratios, and a logistic regression weighs them. Counts are not clipped, neither in training nor
in scoring: as the sum is linear, a distinct word is scored once, and a document is the sum over its distinct words.
"""

import pickle
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import Memo, fit_logistic, grams, logistic
from .shared import BATCH, BATCH_BYTES, forget, give_back, setting, slices, texts

LOW, HIGH, BITS = 3, 6, 22
#: Rows that the classifier is fitted on, at most; the smallest hashes of doc_id are taken.
SAMPLE = 8_000
FEATURES = 20_000
#: Bytes of text that a classifier is fitted on, at most.
TEXT_BYTES = 64_000_000
#: Distinct words whose n-grams are made at once, and characters of texts that are scored at once (a longer text is scored whole).
WORDS, CHARS = 20_000, 250_000


def words_of(text: str) -> set[str]:
    return set(text.lower().split())


class Kept:
    """Texts in UTF-8, each of which is a string only while it's looked at."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw

    def __len__(self) -> int:
        return len(self.raw)

    def __iter__(self) -> Iterator[str]:
        return map(bytes.decode, self.raw)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature, how often) of the n-grams of a text's distinct words."""
    words = sorted(words_of(text))
    parts = [np.unique(grams(words[k : k + WORDS], LOW, HIGH, BITS)[0], return_counts=True) for k in range(0, max(1, len(words)), WORDS)]
    if len(parts) == 1:
        return parts[0]
    f, at = np.unique(np.concatenate([f for f, _ in parts]), return_inverse=True)
    return f, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def telling(seen: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, their log-count ratios) that training keeps. seen: documents that have an n-gram, by label."""
    often = np.flatnonzero(seen[0] + seen[1] >= 3)
    q, p = seen[:, often].astype(float)
    a, b = (p + 1) / (y.sum() + 2), (q + 1) / (len(y) - y.sum() + 2)  # shares of documents that have it
    ratio = np.log(a / b)
    error = np.sqrt((1 - np.minimum(a, 0.99)) / (p + 1) + (1 - np.minimum(b, 0.99)) / (q + 1))
    z = np.abs(ratio) / error
    best = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    best = best[z[best] > 2]
    return often[best], ratio[best]


def train(values: list[str] | Kept, labels: np.ndarray) -> dict:
    """A model from texts and 0/1 labels; with one class only, a constant one."""
    y = np.asarray(labels, float)
    prior = (y.sum() + 1) / (len(y) + 2)
    model = {"keys": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": float(np.log(prior / (1 - prior)))}
    if not 0 < y.sum() < len(y):
        return model
    seen = np.zeros((2, 1 << BITS), np.min_scalar_type(len(y)))
    for text, label in zip(values, y):
        seen[int(label), counted(text)[0]] += 1
    keys, ratio = telling(seen, y)
    del seen
    to = np.full(1 << BITS, -1, np.int32)
    to[keys] = np.arange(len(keys))
    cols, counts, sizes = array("i"), array("f"), []  # they grow in place
    for text in values:  # made anew, so that only the chosen features of all documents are held at once
        f, n = counted(text)
        f = to[f]
        cols.frombytes(f[f >= 0].tobytes())
        counts.frombytes(n[f >= 0].astype(np.float32).tobytes())
        sizes.append(np.count_nonzero(f >= 0))
    del to
    rows, cols = np.repeat(np.arange(len(y), dtype=np.int32), sizes), np.frombuffer(cols, np.int32)
    shares = ratio[cols]
    shares *= np.frombuffer(counts, np.float32)
    del counts
    w, bias = fit_logistic(rows, cols, shares, y, len(keys), l2=1e-3)
    return {"keys": keys, "weights": w * ratio, "bias": bias}


def scorer(model: dict):
    table = np.zeros(1 << BITS, np.float32)
    table[model["keys"]] = model["weights"]

    def score(words: list[str]) -> list[float]:
        f, of = grams(words, LOW, HIGH, BITS)
        return np.bincount(of, table[f], minlength=len(words)).tolist()

    memo = Memo(score)

    def apply(values: list[str]) -> np.ndarray:
        sums: list[float] = []
        while len(sums) < len(values):
            docs, left = [], CHARS
            while left > 0 and len(sums) + len(docs) < len(values):
                text = values[len(sums) + len(docs)]
                docs.append(words_of(text))
                left -= len(text) + 100  # an empty set isn't nothing
            memo.meet(docs)
            sums += [sum(map(memo.__getitem__, d)) for d in docs]
        return logistic(model["bias"] + np.array(sums))

    return apply


def fitted(labelled: DataFrame, docs: DataFrame, label: str, train_on, sample: int, most: int = TEXT_BYTES) -> dict:
    """Joins at most `sample` labelled rows (doc_id and the label) to their texts and trains in one task.

    Of texts that share a doc_id the one of least hash is taken. Texts are taken whole in the order of the hash of doc_id,
    which tells nothing of their length, and the first one that brings their bytes over `most` ends the sample (it is
    taken if there is none before it). So memory is bounded by `most`, or by one text. `train_on` gets the texts as Kept;
    the worker first drops what it keeps for other operators.
    """
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("string").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts(docs).join(F.broadcast(rows), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("place", F.xxhash64("doc_id"))
    rows = rows.repartition(1).sortWithinPartitions("place", "doc_id").select("doc_id", "text", "label")

    def fit(batches):
        forget()
        ids, values, labels, left = [], [], [], most
        for b in batches:
            for doc, text, y in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("label").to_pylist()):
                left -= len(text)
                if left >= 0 or not ids:
                    ids.append(doc)
                    values.append(text)
                    labels.append(y)
        b = text = None  # training then holds the sample alone
        give_back()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        model = train_on(Kept([values[i] for i in order]), [labels[i] for i in order])
        del values
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    with setting(docs.sparkSession, BATCH, BATCH_BYTES):
        found = rows.mapInArrow(fit, "model binary").collect()
    return pickle.loads(found[0][0]) if found else train_on(Kept([]), [])


def fit(docs: DataFrame, labelled: DataFrame, label: str = "toxic", sample: int = SAMPLE, most: int = TEXT_BYTES) -> dict:
    """A model of at most `sample` labelled rows, and of about `most` bytes of text."""
    return fitted(labelled, docs, label, lambda t, y: train(t, np.array(y, float)), sample, most)


def toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1, higher: likelier toxic), predicted (1 if score >= 0.5, else 0).

    Null and empty texts have no n-grams and get the score of the bias alone. Repeated rows get the same score each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        score = scorer(shared.value)
        for b in slices(batches):
            s = score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(apply, "doc_id long, score double, predicted int")


def score_column(spark, model: dict):
    """A function from a text column to its scores, for filters that keep the other columns."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        apply = scorer(shared.value)
        for part in parts:
            values = part.tolist()
            yield pd.Series(np.concatenate([np.zeros(0), *(apply(values[k : k + 500]) for k in range(0, len(values), 500))]))
        give_back()

    return score
