"""N-gram Jaccard join with count vectors: which documents share most of their word shingles.

Shingle length and least similarity are parameters; ``op10`` takes 3 words and 90 %.

1. A document is the set of 64-bit hashes of its distinct shingles.  Equal sets form one class,
   named by its smallest doc_id; only classes are compared.
2. Tokens are hashed into groups.  Two sets that link differ in at most a ninth (at 90 %) of the
   smaller one's size, so with more groups than that some group is the same in both: a (size class,
   group, content) key brings them together.  Groups beyond that number are to spare, and a set
   leaves out its emptiest ones as far as that goes.  Nothing that links is missed, and a shared
   passage alone seldom makes a key, since a group also holds tokens from elsewhere in the text.
3. Every pair is bounded by its count vectors (tokens per hash group) before its sets are compared.
   Under each key every class is first compared with a few pivots of the key, then what is not
   yet connected with the two classes that had most links, which are central in a family of near
   copies.  So a family costs a few comparisons a member, not all pairs.  The links found give
   components.  Only keys that still hold several components are searched further: their count
   vectors go into a packed R-tree, and a pair of different components
   survives if the sum of the coordinate minima, an upper bound of the overlap, reaches what the
   threshold needs.  A key with many classes is cut into blocks; every two blocks meet in a task
   of their own.
4. Survivors are verified on the exact shingle sets, and components made again.

Null, empty or blank texts have no shingles, link with nothing and form a component of their own.
Texts of fewer words than a shingle are one shingle.  Repeated rows are equal sets.  Rows that share a
doc_id count as one document; if their texts differ, the smallest fingerprint stands for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from whence.llm.common import SPREAD, WordHashes, batch_of, batches, mixed, ragged, sieve, sieved, spread, texts
from whence.session import stored

#: Words of a shingle and least similarity in percent, if nothing else is said; set sizes are classed up to a factor
#: WIDEN or more, and one group in SPARE is to spare.
WORDS, PERCENT, WIDEN, SPARE = 3, 90, 1.25, 10
#: Coordinates of a count vector; children of an R-tree node; classes of one key searched in one task.
GROUPS, FANOUT, BLOCK = 256, 16, 2048
#: Pivots of a key in the first comparison; queries and pairs that a search looks at together.
PIVOTS, TOGETHER, CHUNK = 4, 64, 4096
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shingles:
    """The sorted distinct shingle hashes of a text."""

    def __init__(self, length: int = WORDS):
        self.words, self.length = WordHashes(), length

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        h = self.words.of(words)
        if len(h) < self.length:
            return mixed(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), len(h))], np.uint64))
        run = h
        for n in range(1, self.length):
            run = mixed(run[:-1] * (_A if n == 1 else _B) + h[n:])
        return np.unique(mixed(run))


def _needed(a, b, percent: int = PERCENT):
    """Least overlap of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def _differ(size: int, percent: int = PERCENT) -> int:
    """Most elements that are in one of two linked sets only, if the smaller has this size."""
    return size * (100 - percent) // percent


def size_class(size: int, percent: int = PERCENT) -> tuple[int, int]:
    """First size of the class and first beyond it; sizes that only link with equal sets are in none."""
    low = -(-percent // (100 - percent))  # the least size that may differ
    if size < low:
        return 0, low
    widen = max(WIDEN, 100 / percent)  # a linked set is in this class or the next
    while size >= (high := int(low * widen) + 1):
        low = high
    return low, high


def group_keys(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of the groups of the size class, and of the class below if a linked set may be in it.

    At least ``groups - _differ`` groups are the same in two linked sets.  A set leaves out its groups
    of up to ``few`` tokens if these are fewer; then one of the same groups has more, in both sets, so
    whichever of the two has the larger ``few``, a key is left that both have.
    """
    size, keys = len(tokens), []
    low, high = size_class(size, percent)
    if not low:
        return np.zeros(0, np.int64)
    uppers = [high]
    if size * percent <= 100 * (low - 1) and size_class(low - 1, percent)[0]:
        uppers.append(low)  # the class below ends where this begins
    for upper in uppers:
        most = _differ(upper - 1, percent)
        groups = most + 1 + -(-most // SPARE)
        at = (((tokens >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)
        content = np.zeros(groups, np.uint64)
        np.add.at(content, at, mixed(tokens ^ _A))
        held = np.bincount(at, minlength=groups)
        spared = groups - _differ(min(size, upper - 1), percent) - 1
        few = np.flatnonzero(np.cumsum(np.bincount(held)) <= spared)
        content = mixed(content + mixed((np.arange(groups, dtype=np.uint64) + np.uint64(upper << 24)) * _B))
        keys.append(content[held > (few[-1] if len(few) else -1)])
    return np.unique(np.concatenate(keys)).view(np.int64)


def count_vector(tokens: np.ndarray) -> np.ndarray:
    """Tokens by group; of a set too large for 16 bits, a vector that bounds nothing."""
    counts = np.bincount((tokens & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return (counts if counts.max() < 65535 else np.full(GROUPS, 65535)).astype(np.uint16)


class CountTree:
    """A packed R-tree over count vectors: search() gives the pairs whose bounded overlap is enough."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, percent: int = PERCENT):
        self.percent = percent
        self.order = np.lexsort((*(vectors // np.maximum(1, vectors.max() // 4)).T[:3], sizes))
        self.levels = [(vectors[self.order], sizes[self.order], sizes[self.order])]  # upper corner, least and most size
        while len(self.levels[-1][1]) > 1:
            v, least, most = self.levels[-1]
            cut = np.arange(0, len(least), FANOUT)
            self.levels.append((np.maximum.reduceat(v, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)))

    def search(self, vectors: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query, point) numbers."""
        percent = self.percent
        for q0 in range(0, len(sizes), TOGETHER):
            q = np.arange(q0, min(q0 + TOGETHER, len(sizes)))
            node = np.zeros(len(q), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                v, least, most = self.levels[depth]
                if depth < len(self.levels) - 1:  # to the children
                    count = np.minimum((node + 1) * FANOUT, len(least)) - node * FANOUT
                    which, place = ragged(count)
                    q, node = q[which], node[which] * FANOUT + place
                keep = (percent * least[node] <= 100 * sizes[q]) & (100 * most[node] >= percent * sizes[q])
                q, node = q[keep], node[keep]
                need = _needed(sizes[q], np.maximum(least[node], -(-percent * sizes[q] // 100)), percent)
                bound = np.concatenate([np.minimum(vectors[q[i : i + CHUNK]], v[node[i : i + CHUNK]]).sum(1, dtype=np.int64) for i in range(0, max(1, len(q)), CHUNK)])
                q, node = q[bound >= need], node[bound >= need]
            yield q, self.order[node]


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n: set size, hi, lo: fingerprint of the set)."""
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for b in batches(it):
            sets = [shingles(t) for t in texts(b)]
            marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
            yield batch_of(out, (b.column("doc_id"), [len(s) for s in sets], marks[:, 0], marks[:, 1]))

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(part, "doc_id long, n long, hi long, lo long")


def _keyed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, hi, lo, keys) of texts that may link with a different set."""
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for b in batches(it):
            sets = [shingles(t) for t in texts(b)]
            marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
            keys = [group_keys(s, percent) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys)))
            yield batch_of(out, (b.column("doc_id"), [len(s) for s in sets], marks[:, 0], marks[:, 1], lists))

    kind = "doc_id long, n long, hi long, lo long, keys array<long>"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(part, kind).where(F.size("keys") > 0)


def _shared(postings: DataFrame) -> DataFrame:
    """(key, id, pivot) of the keys that several ids have; pivot is the smallest of them.

    Each key's rows come sorted, so the task looks at one row before and holds no group.
    """
    out = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("pivot", pa.int64())])

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, pivot, told = None, None, False  # the last run, whether its pivot's own row is out
        for b in batches(it):
            key, id_ = (np.asarray(b.column(c)) for c in ("key", "id"))
            new = np.append(True, key[1:] != key[:-1])
            new[0] = open_key is None or key[0] != open_key
            run = np.cumsum(new) - 1
            firsts = np.flatnonzero(new)
            pivots = np.append(pivot if pivot is not None else 0, id_[firsts])[run + 1]
            lengths = np.bincount(run + 1, minlength=len(firsts) + 1)
            keep = (lengths[run + 1] > 1) | (run < 0)
            k, i, p = key[keep], id_[keep], pivots[keep]
            if lengths[0] and not told:
                k, i, p = np.append(k, open_key), np.append(i, pivot), np.append(p, pivot)
            last = run[-1]
            told = (told or lengths[0] > 0) if last < 0 else lengths[last + 1] > 1
            open_key, pivot = key[-1], pivots[-1]
            if len(k):
                yield batch_of(out, (k, i, p))

    return postings.repartition("key").sortWithinPartitions("key", "id").mapInArrow(part, "key long, id long, pivot long")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, n, tokens, counts) of these documents: the shingle hashes and the count vector as bytes."""
    out = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("mark", pa.binary()), ("tokens", pa.binary()), ("counts", pa.binary())])

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for b in batches(it):
            sets = [shingles(t) for t in texts(b)]
            yield batch_of(out, (b.column("id"), [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s.tobytes() for s in sets], [count_vector(s).tobytes() for s in sets]))

    found = docs.selectExpr("cast(doc_id as long) id", "text").where(sieved("id", sieve(ids, "id"))).join(ids, "id")
    rows = found.mapInArrow(part, "id long, n long, mark binary, tokens binary, counts binary")
    return rows.groupBy("id").agg(F.min(F.struct("mark", "n", "tokens", "counts")).alias("s")).select("id", "s.n", "s.tokens", "s.counts")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets link; a pair that the count vectors exclude is not compared."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            good = np.zeros(b.num_rows, bool)
            columns = (b.column(c).to_pylist() for c in ("x", "y", "u", "v"))
            for i, (x, y, u, v) in enumerate(zip(*columns, strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                bound = np.minimum(np.frombuffer(u, np.uint16), np.frombuffer(v, np.uint16)).sum(dtype=np.int64)
                if 100 * len(small) >= percent * len(large) and bound >= _needed(len(x), len(y), percent):
                    at = np.searchsorted(large, small)
                    good[i] = np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small) >= _needed(len(x), len(y), percent)
            yield batch_of(out, (np.asarray(b.column("a"))[good], np.asarray(b.column("b"))[good]))

    x = sets.selectExpr("id a", "tokens x", "counts u")
    y = sets.selectExpr("id b", "tokens y", "counts v")
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y", "u", "v").mapInArrow(part, "a long, b long")


def _searched(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of different components under one key whose count vectors allow a link.

    rows: (key, members, id, comp, pivot, n, counts).  Pairs with the pivot were compared before.
    """
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(run: list[np.ndarray], blocks: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        block, id_, comp, n, counts = run
        left = block == blocks[0]
        right = block == blocks[1]
        if not left.any() or not right.any():
            return
        tree = CountTree(counts[right], n[right], percent)
        for q, p in tree.search(counts[left], n[left]):
            q, p = np.flatnonzero(left)[q], np.flatnonzero(right)[p]
            keep = (comp[q] != comp[p]) & ((id_[q] < id_[p]) | (blocks[0] != blocks[1]))
            if keep.any():
                yield batch_of(out, (np.minimum(id_[q], id_[p])[keep], np.maximum(id_[q], id_[p])[keep]))

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches(it):
            cols = [np.asarray(b.column(c)) for c in ("key", "i", "j", "block", "id", "comp", "n")]
            counts = np.frombuffer(b"".join(b.column("counts").to_pylist()), np.uint16).reshape(-1, GROUPS)
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True):
                now = tuple(int(c[lo]) for c in cols[:3])
                if now != at and held:
                    yield from pairs([np.concatenate(x) for x in zip(*held, strict=True)], at[1:])
                    held = []
                at = now
                held.append([*(c[lo:hi] for c in cols[3:]), counts[lo:hi]])
        if held:
            yield from pairs([np.concatenate(x) for x in zip(*held, strict=True)], at[1:])

    blocks = F.ceil(F.col("members") / BLOCK)
    rows = rows.where("id != pivot").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "comp", "n", "counts")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(part, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in the links (a, b); comp is the smallest id reachable.

    Large-star and small-star steps until every id hangs on one root; each round's edges are a table in
    the shared folder.  Minima are combined before the shuffle, and a hub's edges join on an exchange
    of their own, which AQE splits.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x != y").distinct(), "components")
    while _unsettled(edges):
        both = edges.union(edges.select("y", "x"))
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y")
        edges = stored(small.union(least).distinct(), "components")
    return edges.select(F.col("x").alias("id"), F.col("y").alias("comp")).union(edges.select("y", "y").distinct())


def _unsettled(edges: DataFrame) -> bool:
    """Whether some x has two y, or is the y of another: if not, the edges are stars with the smallest id in the middle."""
    ends = edges.select(F.col("x").alias("id"), F.lit(1).alias("up")).union(edges.select("y", F.lit(0)))
    ids = ends.groupBy("id").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return bool(ids.agg(F.max(F.expr("up > 1 or up = 1 and least = 0"))).first()[0])


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (id, comp) with more links (a, b): only those between its components are followed."""
    for end in ("a", "b"):
        of = comp.select(F.col("id").alias(end), F.col("comp").alias("of"))
        links = links.join(of, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    more = components(links).toDF("was", "now")
    old = comp.join(more, F.col("comp") == F.col("was"), "left").select("id", F.coalesce("now", "comp").alias("comp"))
    new = more.join(comp, F.col("was") == F.col("id"), "left_anti")
    return stored(old.union(new), "components")


def _with_component(shared: DataFrame, comp: DataFrame) -> DataFrame:
    return shared.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _stars(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Pairs (a, b) of each key's members and its pivots; known components are not compared in themselves.

    pivots: (key, p), p an array of ids, or of (id, comp) if the members have components.
    """
    pairs = spread(members, "key").join(spread(pivots, "key"), ["key", SPREAD]).withColumn("p", F.explode("p"))
    if "comp" in members.columns:
        pairs = pairs.where("comp != p.comp").withColumn("p", F.col("p.id"))
    return pairs.where("id != p").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Texts link if they share ``percent`` (50 to 99) of their shingles of ``words`` words.
    """
    if words < 1 or not 50 <= percent <= 99:
        raise ValueError("shingles need a word, and 50 to 99 percent")
    docs = docs.select("doc_id", "text")
    marks = stored(fingerprints(docs, words), "shingle-sets")
    classes = marks.where("n > 0").groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("id"))
    sets_of = _keyed(docs, words, percent).groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"))
    shared = stored(_shared(sets_of.where("id is not null").select("id", F.explode("keys").alias("key"))), "shared-groups")
    sets = stored(_sets(docs, shared.select("id").distinct(), words), "candidate-sets")

    by_hash = [F.min_by("id", F.xxhash64(F.lit(k), "id")) for k in range(1, PIVOTS)]
    pivots = shared.groupBy("key").agg(F.array_distinct(F.array(F.first("pivot"), *by_hash)).alias("p"))
    links = stored(_verified(_stars(shared, pivots), sets, percent), "links")
    comp = components(links)
    held = _with_component(shared, comp)

    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    central = held.join(degree, "id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    best = [F.max_by(F.struct("id", "comp"), F.struct("links", F.xxhash64(F.lit(k), "id"))) for k in (0, 1)]
    several = (F.count(F.lit(1)) > 2) & (F.min("comp") != F.max("comp"))
    pivots = central.groupBy("key").agg(F.array_distinct(F.array(*best)).alias("p"), several.alias("open")).where("open")
    comp = merged(comp, stored(_verified(_stars(held, pivots.drop("open")), sets, percent), "links"))
    held = _with_component(shared, comp)

    keys = held.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    keys = keys.where("members > 2 and least != most").select("key", "members")
    rows = spread(held, "key").join(spread(keys, "key"), ["key", SPREAD]).drop(SPREAD)
    more = _searched(rows.join(sets.select("id", "n", "counts"), "id"), percent)
    comp = merged(comp, stored(_verified(more, sets, percent), "links"))

    named = classes.join(comp, "id", "left").select("n", "hi", "lo", F.coalesce("comp", "id").alias("comp"))
    rows = marks.join(named, ["n", "hi", "lo"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; of a repeated doc_id one row stays.

    Rows without a doc_id cannot be told apart by it and stay.
    """
    ids = stored(joined(docs, words, percent).where("doc_id = component_id").select("doc_id").distinct(), "kept-ids")
    # the join has brought equal ids together and sorted them; numbering them needs no shuffle
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))
    kept = docs.join(ids, "doc_id").withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return kept.unionByName(docs.where("doc_id is null")).select(docs.columns)
