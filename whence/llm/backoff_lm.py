"""LM scoring with stupid backoff: n-gram count tables partitioned by hash, joined to the documents' n-grams.

1. Documents become blocks of words as numbers of the block's vocabulary (64-bit word hashes), a
   table in the shared folder, bucketed by block so that answers join it where it lies.
2. Every block is exploded into its distinct 1- and 2-grams with their counts, cut by hash range into
   parts.  This is the count table before its last aggregation: hot n-grams are one entry a block.
3. Each hash part adds up its blocks' counts and answers each block's entries with what other blocks hold.
4. Then follow the longer n-grams, one length at a time and only where both (n-1)-grams in them occur
   in another document: where one doesn't, the n-gram can't either, in any block, so no count is lost.
5. The answers are joined to the blocks, and log scores are summed per document.

A word's score is count(n-gram) / count(its context), or ``BACKOFF`` times the score with a
shorter context where the n-gram does not occur.  Counts leave out the document itself, as a text
would else vouch for its own rare words.  A word that no other document has counts half.

Words are runs without ASCII white space.  Null and empty texts have no words and score 0.
Repeated rows are documents of their own and vouch for each other.  Counts cover all documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whence.llm.common import WordHashes, batch_of, batches, mixed, texts
from whence.session import shared_folder

#: Longest n-gram; factor of a shorter context; words of a block (a longer text is a block alone); entries of a hash part.
ORDER, BACKOFF, BLOCK, PART = 3, 0.4, 500_000, 2_000_000
_A = np.uint64(0x9E3779B97F4A7C15)


def packed(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    return zstandard.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def unpacked(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8)
    planes = planes.reshape(size, len(planes) // size)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def sorted_packed(x: np.ndarray) -> bytes:
    """Small if the integers mostly ascend; any order comes back right."""
    return packed(np.diff(x, prepend=np.uint64(0)))


def sorted_unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, np.uint64), dtype=np.uint64)


_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("vocabulary", pa.binary()), ("words", pa.binary())])
_BLOCK_DDL = "block long, ids array<long>, lengths array<long>, vocabulary binary, words binary"


def blocks(docs: DataFrame) -> DataFrame:
    """Documents as blocks of word numbers."""

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number, size = WordHashes(), 0, 0
        ids: list[int] = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            vocabulary, words, times = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            # frequent words get small numbers, which pack better; among words about as frequent, hashes stay sorted
            order = np.lexsort((vocabulary, -np.log2(times).astype(np.int64)))
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            vocabulary, words = vocabulary[order], rank[words]
            name = (TaskContext.get().partitionId() << 32) + number
            return batch_of(_BLOCK, ([name], [ids], [[len(h) for h in held]], [sorted_packed(vocabulary)], [packed(words)]))

        for b in batches(it):
            for doc, text in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                ids.append(doc)
                held.append(hashes.of(text.encode("utf-8", "surrogatepass").split()))
                size += len(held[-1])
                if size >= BLOCK or len(ids) >= BLOCK // 10:
                    yield block()
                    ids, held, number, size = [], [], number + 1, 0
        if ids:
            yield block()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(part, _BLOCK_DDL)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Write a table in the shared folder, bucketed by a column, and read it again.

    Buckets need a name in the session's catalog, which stays as the files do.
    """
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    df.write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(name)
    return spark.table(name)


class Asked:
    """Distinct n-grams of a block with their counts, and which of them ends at each word (-1: none)."""

    def __init__(self, block: Block, found: list[tuple[np.ndarray, np.ndarray]]):
        self.doc = block.doc
        self.grams, which, self.counts = np.unique(np.concatenate([g for _, g in found]), return_inverse=True, return_counts=True)
        self.at = []
        for (ends, _), w in zip(found, np.split(which, np.cumsum([len(g) for _, g in found])[:-1]), strict=True):
            at = np.full(len(block.doc), -1, np.int64)
            at[ends] = w
            self.at.append(at)

    def others(self, outside: np.ndarray) -> list[np.ndarray]:
        """How often each word's n-gram occurs in other documents, given its count in other blocks."""
        out = []
        for at in self.at:
            here = at >= 0
            _, which, own = np.unique(self.doc[here] * (len(self.grams) + 1) + at[here], return_inverse=True, return_counts=True)
            count = np.zeros(len(at), np.int64)
            count[here] = (outside + self.counts)[at[here]] - own[which]
            out.append(count)
        return out


class Block:
    """The words of a block and the n-grams that end at them."""

    def __init__(self, lengths: list[int], vocabulary: bytes, words: bytes):
        self.lengths = np.array(lengths, np.int64)
        self.words = sorted_unpacked(vocabulary)[unpacked(words, np.uint32)] if self.lengths.sum() else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def asked(self, lengths: range, others: list[np.ndarray]) -> Asked:
        """The n-grams of these lengths whose counts can matter; ``others`` has the counts of all shorter ones."""
        found, run = [], self.words
        for n in range(1, lengths.stop):
            if n > 1:
                run = mixed(run[:-1] * _A + self.words[n - 1 :]) if len(run) else run
            if n >= lengths.start:
                live = self.place >= n - 1
                if n > 1 and n - 2 < len(others):
                    shorter = others[n - 2] > 0
                    live[1:] &= shorter[1:] & shorter[:-1]
                ends = np.flatnonzero(live)
                found.append((ends, mixed(run[ends - (n - 1)] + np.uint64(n))))
        return Asked(self, found)

    def others(self, rounds: list[range], answers: list[list | None]) -> list[np.ndarray]:
        """Occurrences in other documents by length, from the answers to the rounds so far."""
        others: list[np.ndarray] = []
        for lengths, got in zip(rounds, answers, strict=True):
            outside = np.concatenate([unpacked(x["outside"], np.uint64) for x in got or []] or [np.zeros(0, np.uint64)])
            others += self.asked(lengths, others).others(outside.astype(np.int64))
        return others


def _columns(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    for i in range(b.num_rows):
        yield tuple(b.column(n)[i].as_py() for n in names)


def counted(state: DataFrame, rounds: list[range], parts: int) -> DataFrame:
    """(block, part, outside): for a block's n-grams of the last round in a hash part, in order, their counts in other blocks."""
    asked = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
    answer = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("outside", pa.binary())])
    answers = [f"answers{k}" for k in range(len(rounds) - 1)]

    def explode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = -(-(1 << 64) // parts)
        for b in batches(it):
            for block, lengths, vocabulary, words, *got in _columns(b, "block", "lengths", "vocabulary", "words", *answers):
                held = Block(lengths, vocabulary, words)
                own = held.asked(rounds[-1], held.others(rounds[:-1], got))
                cuts = [0, *np.searchsorted(own.grams, np.array([width * k for k in range(1, parts)], np.uint64)).tolist(), len(own.grams)]
                for k in range(parts):
                    if (lo := cuts[k]) < (hi := cuts[k + 1]):
                        yield batch_of(asked, ([block], [k], [sorted_packed(own.grams[lo:hi])], [packed(own.counts[lo:hi].astype(np.uint32))]))

    def total(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        grams = [sorted_unpacked(g) for _, _, g, _ in rows]
        counts = np.concatenate([unpacked(c, np.uint32) for *_, c in rows])
        _, which = np.unique(np.concatenate(grams), return_inverse=True)
        outside = np.bincount(which, counts).astype(np.uint64)[which] - counts
        for (block, k, *_), own in zip(rows, np.split(outside, np.cumsum([len(g) for g in grams])[:-1]), strict=True):
            yield batch_of(answer, ([block], [k], [packed(own)]))

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches(it):
            for row in _columns(b, "block", "part", "grams", "counts"):
                if held and held[0][1] != row[1]:
                    yield from total(held)
                    held = []
                held.append(row)
        if held:
            yield from total(held)

    rows = state.mapInArrow(explode, "block long, part long, grams binary, counts binary")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(add, "block long, part long, outside binary")


def scored(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """(doc_id, n_words, log_score, word_score): the sum and the mean of the words' log scores."""
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), bytes_ // (8 * BLOCK)), 100_000)
    table = bucketed(blocks(docs), "word_blocks", "block", buckets)
    size = table.agg(F.sum(F.expr("aggregate(lengths, 0L, (s, x) -> s + x)"))).first()[0] or 0
    rounds = [range(1, min(2, order) + 1), *(range(n, n + 1) for n in range(3, order + 1))]
    state = table
    for k, lengths in enumerate(rounds):
        totals = counted(state, rounds[: k + 1], max(1, -(-len(lengths) * size // PART)))
        # as many entries as the block has
        answers = totals.repartition(buckets, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "outside"))).alias(f"answers{k}"))
        state = state.join(answers, "block", "left")
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("word_score", pa.float64())])

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for ids, lengths, vocabulary, words, *got in _columns(b, "ids", "lengths", "vocabulary", "words", *(f"answers{k}" for k in range(len(rounds)))):
                own = Block(lengths, vocabulary, words)
                others = own.others(rounds, got)
                n = own.lengths[own.doc]
                score = np.maximum(others[0], 0.5) / (size - n + 1)
                for k in range(1, order):
                    # the context is the shorter n-gram that ends one word before
                    context = np.concatenate([[0], others[k - 1][:-1]]) if len(n) else others[k]
                    score = np.where(others[k] > 0, others[k] / np.maximum(context, 1), np.where(own.place >= k, backoff * score, score))
                logs = np.bincount(own.doc, np.log(score), len(ids))
                yield batch_of(out, (ids, own.lengths, logs, logs / np.maximum(own.lengths, 1)))

    return state.mapInArrow(part, "doc_id long, n_words long, log_score double, word_score double")
