"""Ranked lexical search: term-at-a-time evaluation with a limited set of accumulators.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case.  A
document's score for an item is the sum, over the item's terms with repeats, of a term weight
times a saturated frequency that long documents reach later; all but the weight is whole-number
arithmetic (see ``weight`` and ``impacts``).

1. Documents are scanned once for the terms of a block of items; shards of documents become
   postings by term, a table in the shared folder.  Documents, their terms and document
   frequencies are counted over all of them.
2. Each shard takes an item's terms rarest first.  As long as what the remaining terms can add
   reaches the k-th best partial score (or the k-th best score of the task's earlier shards),
   every posting may open an accumulator; after that, terms only add to accumulators that
   exist, looked up in the term's postings, so every score that is kept is exact.
3. The shards' best are merged in two steps, first by salt, then by item.

Items come in blocks of bounded size, one job each, so neither driver nor closures hold the
whole of a large item table.

Null and empty texts have no terms: such documents are never found, such items find nothing.
Repeated documents and items are rows of their own: each is ranked.  Equal scores are ordered by
doc_id, null last.  Texts of any length are read whole; empty tables give an empty result.
Only ``doc_id``, ``item_id`` and ``text`` are read, other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from whence.llm.common import batch_of, batches, texts
from whence.session import stored

#: Documents reported for an item; documents and postings of a shard; items and characters of a block; salts of the merge.
TOP, SHARD_DOCS, SHARD_POSTINGS, BLOCK_ITEMS, BLOCK_CHARS, SALTS = 20, 50_000, 4_000_000, 5_000, 2_000_000, 16
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_LAST = np.iinfo(np.int64).max


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Saturated frequencies of postings; ``n`` is the length of each posting's document."""
    m = 75 + (25 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


_SHARD = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("terms", pa.list_(pa.int32())), ("dfs", pa.list_(pa.int64())),
                    ("at", pa.binary()), ("tf", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
_SHARD_DDL = "ids array<long>, lengths binary, terms array<int>, dfs array<long>, at binary, tf binary, n_docs long, n_terms long"


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Shards of documents: which of the vocabulary's terms are in which documents, by term."""
    width = max(1, len(vocabulary))

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []  # term * SHARD_DOCS + document, sorted, with its count
        counts: list[np.ndarray] = []
        room = 2 * SHARD_DOCS + 1000  # more documents than a shard has

        def shard() -> pa.RecordBatch:
            keys, tf = np.concatenate(held), np.concatenate(counts)
            order = np.argsort(keys, kind="stable")
            keys, tf = keys[order], tf[order]
            found, dfs = np.unique(keys // room, return_counts=True)
            n = np.array(lengths, np.int64)
            return batch_of(_SHARD, ([ids], [n.tobytes()], [found.tolist()], [dfs.tolist()], [(keys % room).astype(np.int32).tobytes()],
                                     [tf.astype(np.int32).tobytes()], [int(np.count_nonzero(n))], [int(n.sum())]))

        size = 0
        for b in batches(it):
            first, found = len(ids), []
            for text in texts(b):
                own = terms(text)
                lengths.append(len(own))
                found.append([k for t in own if (k := vocabulary.get(t)) is not None])
            ids += b.column("doc_id").to_pylist()
            which = np.repeat(np.arange(first, len(ids)), [len(f) for f in found])
            keys, times = np.unique(np.array([k for f in found for k in f], np.int64) * room + which, return_counts=True)
            held.append(keys)
            counts.append(times)
            size += len(keys)
            if len(ids) >= SHARD_DOCS or size >= SHARD_POSTINGS:
                yield shard()
                ids, lengths, held, counts, size = [], [], [], [], 0
        if ids:
            yield shard()

    assert width < 1 << 31
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(part, _SHARD_DDL)


class Best:
    """The best ``top`` (score, document) of one item so far."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    @property
    def floor(self) -> int:
        """What a document must reach to get in; 0 while there is room."""
        return self.rows[-1][0] if len(self.rows) == self.top else 0

    def add(self, scores: Iterable[int], ids: Iterable) -> None:
        self.rows += zip(scores, ids)
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        del self.rows[self.top :]


def kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def evaluate(wanted: list[tuple[int, int]], lists: dict[int, tuple[np.ndarray, np.ndarray, int]], scores: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, their exact scores, accumulators opened) of one item in one shard.

    ``wanted`` are (term, factor), rarest first; ``lists`` give a term's documents, impacts and
    greatest impact; ``scores`` is a zeroed array over the shard's documents, zeroed again afterwards.
    """
    own = [(*lists[t], factor) for t, factor in wanted if t in lists and factor > 0]
    left = np.append(np.cumsum([most * factor for *_, most, factor in own][::-1])[::-1], 0).astype(np.int64)
    live, j = np.zeros(0, np.int64), 0
    while j < len(own) and left[j] >= max(1, floor, kth(scores[live], top)):
        at, impact, _, factor = own[j]
        scores[at] += impact * factor
        live = np.union1d(live, at) if len(live) else at
        j += 1
    for at, impact, _, factor in own[j:]:  # no document outside can get in any more
        place = np.minimum(np.searchsorted(at, live), len(at) - 1)
        hit = at[place] == live
        scores[live[hit]] += impact[place[hit]] * factor
    found = scores[live].copy()
    scores[live] = 0
    return live, found, len(live)


def ranked(shards: DataFrame, items: list[tuple[object, dict[int, int]]], weights: dict[int, int], rarity: dict[int, int], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, item_id, doc_id, score): each task's best documents for each item."""
    out = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    asked = [(i, item_id, sorted(((t, n * weights[t]) for t, n in own.items() if t in weights), key=lambda x: (rarity[x[0]], x[0])))
             for i, (item_id, own) in enumerate(items)]

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in asked]
        for b in batches(it):
            for row in range(b.num_rows):
                ids, lengths, found, dfs, at, tf = (b.column(c)[row].as_py() for c in ("ids", "lengths", "terms", "dfs", "at", "tf"))
                at, tf, n = np.frombuffer(at, np.int32).astype(np.int64), np.frombuffer(tf, np.int32).astype(np.int64), np.frombuffer(lengths, np.int64)
                impact = impacts(tf, n[at], n_docs, n_terms)
                cuts = np.cumsum(dfs)[:-1] if dfs else []
                lists = {t: (a, x, int(x.max())) for t, a, x in zip(found, np.split(at, cuts), np.split(impact, cuts))}
                scores = np.zeros(len(ids), np.int64)
                for i, _, wanted in asked:
                    live, got, _ = evaluate(wanted, lists, scores, top, best[i].floor)
                    enough = max(1, best[i].floor, kth(got, top))
                    keep = np.flatnonzero(got >= enough)
                    best[i].add(got[keep].tolist(), [ids[d] for d in live[keep].tolist()])
        rows = [(i, item_id, doc, score) for i, item_id, _ in asked for score, doc in best[i].rows]
        if rows:
            yield batch_of(out, [list(c) for c in zip(*rows)])

    return shards.select("ids", "lengths", "terms", "dfs", "at", "tf").mapInArrow(part, "item int, item_id long, doc_id long, score long")


def blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Blocks of items with their terms, each of bounded size (a longer item is a block alone)."""
    held: list = []
    size = 0
    for r in items.selectExpr("cast(item_id as long) item_id", "text").toLocalIterator():
        text = r.text or ""
        if held and (size + len(text) > BLOCK_CHARS or len(held) >= BLOCK_ITEMS):
            yield held
            held, size = [], 0
        held.append((r.item_id, terms(text)))
        size += len(text)
    if held:
        yield held


def searched(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0."""
    parts = []
    for block in blocks(items):
        vocabulary: dict[bytes, int] = {}
        wanted = []
        for item_id, own in block:
            counts: dict[int, int] = {}
            for t in own:
                k = vocabulary.setdefault(t, len(vocabulary))
                counts[k] = counts.get(k, 0) + 1
            wanted.append((item_id, counts))
        shards = stored(postings(docs, vocabulary), "postings")
        n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        df = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df"))
        rarity = {r.terms: r.df for r in df.toLocalIterator()}  # as many as the block has terms
        weights = {t: w for t, n in rarity.items() if (w := weight(n_docs, n)) > 0}
        best = ranked(shards, wanted, weights, rarity, n_docs, max(1, n_terms), top)
        order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))
        some = best.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order)))
        some = some.where(F.col("rank") <= top)
        whole = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        parts.append(stored(whole.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, parts)
