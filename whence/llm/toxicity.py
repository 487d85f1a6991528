"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Each sentence has a probability from a logistic model over its words and a bias; the
document's is the noisy-or, P = 1 - prod(1 - p).  A word counts by its hash and by the hashes of its
first ``PREFIXES`` letters, so inflections of one stem add up; a word counts once in a sentence.  The model is trained from document labels
alone: the gradient of the noisy-or likelihood gives each sentence its share of the blame.  A
share ``NOISE`` of the labels may be wrong, so a document that nothing explains teaches little.
Scoring also names the offending sentences.

Null and empty texts have no sentence and score 0.  Repeated rows get a result row each, alike.
Equal scores are equal decisions; offending sentences are listed in the order of the text.  Texts of any length
are read whole, sentence by sentence; a text without an end mark is one sentence.  Empty tables give an empty result.
The score counts what speaks for toxicity beyond the prior, which in a long text would add up by itself;
so without labelled rows every score is 0 and no document goes.  Only ``doc_id`` and ``text`` (and the label) are
read: ``clean`` keeps all columns of the input, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame

from whence.llm.common import batch_of, batches, mixed, texts
from whence.llm.linear import Ftrl, fitted, labelled, sigmoid

#: Hash buckets; labelled documents to learn from; passes, and documents seen at least;
#: a sentence's logit before learning; wrong labels; lengths of prefixes; words whose features are kept.
BITS, BOUND, EPOCHS, STEPS, PRIOR, NOISE, PREFIXES, KEPT = 20, 16_384, 3, 24_000, -6.0, 0.02, (4, 5, 6, 7, 8), 200_000
_END = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> tuple[list[str], list[str], np.ndarray]:
    """Sentences that have words, the different words of each, and where each sentence's words start."""
    own = [(s, w) for s in _END.split(text) if (w := list(dict.fromkeys(_WORD.findall(s.lower()))))]
    starts = np.cumsum([0, *(len(w) for _, w in own)])[:-1]
    return [s for s, _ in own], [w for _, ws in own for w in ws], starts


def buckets(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' features, laid end to end, and where each word's start; bucket 0 is the bias's."""
    features = [[f"{w} ", *(w[:k] for k in PREFIXES if k <= len(w))] for w in words]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, (f for own in features for f in own)), np.uint64)
    at = (mixed(hashes) >> np.uint64(64 - bits)).astype(np.int64)
    return np.maximum(at, 1), np.cumsum([0, *map(len, features)])[:-1]


class WordWeights(dict):
    """What a word adds to its sentence, worked out once; emptied when it holds ``KEPT`` words."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.bits, self.all = len(weights).bit_length() - 1, weights.astype(np.float64)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > KEPT:
            self.clear()
        if new := [w for w in dict.fromkeys(words) if w not in self]:
            at, starts = buckets(new, self.bits)
            self.update(zip(new, np.add.reduceat(self.all[at], starts).tolist()))
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def _chances(dots: np.ndarray) -> tuple[np.ndarray, float]:
    """Sentence probabilities and their noisy-or."""
    p = np.minimum(sigmoid(dots + PRIOR), 1 - 1e-12)
    return p, float(-np.expm1(np.log1p(-p).sum())) if len(p) else 0.0


def _scored(words: np.ndarray, starts: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Sentence probabilities and the noisy-or of what they have beyond the prior."""
    p, _ = _chances(np.add.reduceat(words, starts) + bias if len(words) else np.zeros(0))
    prior = sigmoid(PRIOR)
    beyond = np.maximum(p - prior, 0) / (1 - prior)
    return p, float(-np.expm1(np.log1p(-beyond).sum())) + 0.0 if len(p) else 0.0


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bits: int = BITS, bound: int = BOUND, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learned from document labels where ``learn`` holds (a column of ``labels``), in one model."""

    def train(sample: Iterator[tuple[str, float]]) -> np.ndarray:
        model, number, rows = Ftrl(1 << bits, alpha=1.0, beta=0.05, l1=4.0), {}, []
        for text, y in sample:  # of a text only word numbers stay
            _, words, starts = sentences(text)
            if words:
                rows.append((np.array([number.setdefault(w, len(number)) for w in words], np.int32), starts, y))
        at, first = buckets(list(number), bits)
        many = np.diff(np.append(first, len(at)))
        for _ in range(max(epochs, STEPS // max(1, len(rows)))):
            for words, starts, y in rows:
                unique, place = np.unique(words, return_inverse=True)
                # the features of the document's words, each word's together
                of = np.repeat(np.arange(len(unique)), many[unique])
                features = at[np.repeat(first[unique] - np.concatenate([[0], np.cumsum(many[unique])[:-1]]), many[unique]) + np.arange(len(of))]
                found, where = np.unique(np.append(features, 0), return_inverse=True)  # 0: the bias
                w = model.weights(found)
                word = np.bincount(of, w[where[:-1]], len(unique))
                p, whole = _chances(np.add.reduceat(word[place], starts) + w[where[-1]])
                told = NOISE + (1 - 2 * NOISE) * whole  # chance of the label 1
                blame = (1 - 2 * NOISE) * (1 - whole) / (1 - told if y == 0 else -told) * p
                each = np.bincount(place, np.repeat(blame, np.diff(np.append(starts, len(words)))), len(unique))
                g = np.bincount(where, np.append(each[of], blame.sum()), len(found))
                model.update(found, g, w)
        return model.weights()

    return fitted(labelled(docs, labels, label, learn, bound), train, 1 << bits, shards=1)


def score(docs: DataFrame, weights: np.ndarray, offends: float = 0.5) -> DataFrame:
    """(doc_id, score, offending): offending has the sentences whose own probability is ``offends`` or more."""
    sentence = pa.struct([("sentence", pa.int32()), ("score", pa.float64()), ("text", pa.string())])
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("offending", pa.list_(sentence))])

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bias = WordWeights(weights), float(weights[0])
        for b in batches(it):
            scores, found = [], []
            for text in texts(b):
                own, words, starts = sentences(text)
                p, whole = _scored(known.of(words), starts, bias)
                scores.append(whole)
                found.append([{"sentence": int(i), "score": float(p[i]), "text": own[i]} for i in np.flatnonzero(p >= offends)])
            yield batch_of(out, (b.column("doc_id"), scores, found))

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        part, "doc_id long, score double, offending array<struct<sentence int, score double, text string>>"
    )


def clean(docs: DataFrame, weights: np.ndarray, decide: float) -> DataFrame:
    """The rows of ``docs`` whose score is below ``decide``, with all their columns."""

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bias = WordWeights(weights), float(weights[0])
        for b in batches(it):
            scores = []
            for text in texts(b):
                _, words, starts = sentences(text)
                scores.append(_scored(known.of(words), starts, bias)[1])
            yield b.filter(pa.array(np.array(scores) < decide))

    return docs.mapInArrow(part, docs.schema)
