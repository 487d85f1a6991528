"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL updates.

A document's features are its word 1- and 2-grams, the 1- and 2-grams of word shapes (``The``
is ``Aa``, ``of%%%`` is ``a%``), and words that follow themselves.  Each family's counts are
scaled to sqrt(count / words), so long and short texts compare; the score is one sparse dot
product and a sigmoid.

Null and empty texts have no features and get the score of the bias alone.  Repeated rows are
scored alike, one result row each.  Without labelled rows every score is 0.5.  Texts of any length are read whole; empty
tables give an empty result; equal scores are equal decisions.  Only ``doc_id`` and ``text`` (and the label) are read, other
columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame

from whence.llm.common import WordHashes, batch_of, batches, mixed, texts
from whence.llm.linear import Ftrl, fitted, labelled, sigmoid

#: Hash buckets; labelled documents to learn from; passes over them.
BITS, BOUND, EPOCHS = 18, 16_384, 3
_RUNS = [(re.compile(p), r) for p, r in ((r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a"), (r"\d+", "0"), (r"([^\w])\1+", r"\1"))]


class Shapes(WordHashes):
    def __missing__(self, word: str) -> int:
        shape = word
        for pattern, to in _RUNS:
            shape = pattern.sub(to, shape)
        h = self[word] = xxhash.xxh3_64_intdigest(shape)
        return h


class Features:
    """(buckets, values) of a text; bucket 0 is the bias."""

    def __init__(self, bits: int = BITS):
        self.words, self.shapes, self.shift = WordHashes(), Shapes(), np.uint64(64 - bits)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.zeros(1, np.int64), np.ones(1)
        h, s = self.words.of(words), self.shapes.of(words)
        again = np.full(np.count_nonzero(h[1:] == h[:-1]), 11, np.uint64)
        two = np.uint64(0x9E3779B97F4A7C15)
        salted = [mixed(x + np.uint64(k)) for k, x in enumerate((h, h[:-1] * two + h[1:], s, s[:-1] * two + s[1:], again), 1)]
        at, count = np.unique(np.concatenate(salted) >> self.shift, return_counts=True)
        return np.append(at.astype(np.int64), 0), np.append(np.sqrt(count / len(words)), 1.0)


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bits: int = BITS, bound: int = BOUND, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learned from the labels where ``learn`` holds (a column of ``labels``)."""

    def train(sample: Iterator[tuple[str, float]]) -> np.ndarray:
        features, model = Features(bits), Ftrl(1 << bits)
        rows = [(features(t), y) for t, y in sample]
        for _ in range(epochs):
            for (at, x), label in rows:
                at, first = np.unique(at, return_index=True)
                w = model.weights(at)
                model.update(at, (sigmoid(w @ x[first]) - label) * x[first], w)
        return model.weights()

    return fitted(labelled(docs, labels, label, learn, bound), train, 1 << bits)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row, from its whole text."""
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(weights).bit_length() - 1)
        for b in batches(it):
            dots = [float(weights[at] @ x) for at, x in map(features, texts(b))]
            yield batch_of(out, (b.column("doc_id"), sigmoid(np.array(dots))))

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(part, "doc_id long, score double")
