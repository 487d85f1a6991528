"""Follow-the-regularised-leader updates of a sparse linear model, and how documents reach it.

Training reads a bounded sample of labelled rows (``bound``), dealt by a hash of doc_id to a
fixed number of shards; each shard makes its updates in one task, and the shards' weights
are averaged (parameter mixing).  Only these weights, ``SHARDS`` arrays of a fixed length,
reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.llm.common import batches, texts

SHARDS = 2


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, at: np.ndarray, g: np.ndarray, w: np.ndarray) -> None:
        """``at`` without repetitions; ``w`` the weights there."""
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int) -> DataFrame:
    """(doc_id, text, y): about ``bound`` labelled documents at most, chosen by a hash of doc_id.

    A doc_id labelled twice has its larger label; of a doc_id with several texts the smallest counts.
    The sample of labels has a bounded number of rows and is broadcast, so no text is shuffled.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("y"))
    share = min(1.0, bound / max(1, rows.count()))
    kept = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = docs.select("doc_id", "text").join(F.broadcast(kept), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def fitted(sample: DataFrame, train: Callable[[Iterator[tuple[str, float]]], np.ndarray], size: int, shards: int = SHARDS) -> np.ndarray:
    """The mean of the shards' weights; zeros without labelled rows.

    A shard is one task, which streams its documents, in the order of a hash, into ``train``.
    """

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, float]]:
        for b in batches(it):
            yield from zip(b.column("shard").to_pylist(), texts(b), b.column("y").to_pylist())

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groupby(rows(it), key=lambda r: r[0]):
            w = train((text, float(y)) for _, text, y in own)
            yield pa.RecordBatch.from_pydict({"w": [w.astype(np.float32).tobytes()]})

    at = F.xxhash64(F.lit(7), F.col("doc_id").cast("long"))
    dealt = sample.select(at.alias("at"), F.pmod(at, F.lit(shards)).alias("shard"), "text", "y")
    ordered = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "at").select("shard", "text", "y")
    # a row for each shard; a local iterator would run a job for each partition
    parts = [np.frombuffer(r.w, np.float32) for r in ordered.mapInArrow(part, "w binary").collect()]
    return np.mean(parts, axis=0) if parts else np.zeros(size, np.float32)
