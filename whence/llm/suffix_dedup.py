"""Suffix-array dedup: removes every byte covered by a 200-byte string that also starts elsewhere.

Every 200-byte window has an anchor, the smallest hash among its 32-byte grams (the last of
equals).  Equal windows have the same anchor gram at the same place, so only windows of equal
grams can be equal, and the windows that share one anchor are one context of at most 368 bytes.

1. Anchors of all texts, with the gram's hash, the context's hash and its place.
2. Grams that occur once are dropped; a context that occurs twice is covered as a whole, so long
   copies never need their bytes compared.
3. What is left are the edges of repeated passages: different contexts around one gram.  Their
   texts to the right and, reversed, to the left of the anchor are put into suffix arrays by
   deep-shallow sorting: multikey quicksort on 8-byte words to a shallow depth, then a blind trie
   for each group with a longer common prefix.  The arrays' common prefix lengths tell for every
   window which others it equals.
   Grams with more than ``CROWD`` different contexts are not gathered: their windows are counted
   by hash with partial aggregation.
4. The spans are joined to their texts and cut out.

Null and empty texts, and texts under 200 bytes, lose nothing.  Repeated rows, also of one
doc_id, are strings that start elsewhere.  Very long texts are scanned in overlapping segments.
An empty table gives an empty result; an anchor's ties go to the last of equal grams.

Texts are known by 128 bits (``RID``).  Contexts are compared by the hash of their gram together with a hash of their own,
64 bits each; windows at the edges of repeats by their bytes, those of crowded grams by 128 bits.
Existing columns ``spans`` and ``kept`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whence.llm.common import SPREAD, added, batch_of, batches, mixed, ragged, sieve, sieved, spread, without
from whence.session import stored

#: Bytes of a repeated string; of an anchor's gram; of a scan; contexts sorted at once; contexts of a crowded gram.
LENGTH, GRAM, SEGMENT, SORTED, CROWD = 200, 32, 1 << 19, 8_000, 8_000
#: Words of 8 bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 3
#: A text's number: two hashes of 64 bits with different seeds.
RID = ("rid", "rid2")
_WINDOW = LENGTH - GRAM + 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# ---- anchors ---------------------------------------------------------------


def _hashes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 32-byte and of all 128-byte strings."""
    h = (c.astype(np.uint64) + np.uint64(1)) * _A
    grams, n = h, 1
    while n < 128:
        h ^= h >> np.uint64(31)
        h = h[:-n] * np.uint64(0xBF58476D1CE4E5B9 + 2 * n) + h[n:]
        n *= 2
        if n == GRAM:
            grams = h.copy()
    return mixed(grams), h


def anchors(c: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, bytes of context, anchor's place in it, gram hash, context hash) of runs of valid window starts."""
    grams, long = _hashes(c)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
    n = 1
    while n * 2 <= _WINDOW:
        key = np.minimum(key[:-n], key[n:])
        n *= 2
    key = np.minimum(key[: len(c) - LENGTH + 1], key[_WINDOW - n :])
    at = np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))
    at = np.where(valid[: len(at)], at.astype(np.int64), -1)
    cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    first, last = cut, np.append(cut[1:], len(at)) - 1
    keep = at[cut] >= 0
    first, last = first[keep], last[keep]
    place, end = at[first], last + LENGTH
    size = end - first
    context = long[first] * _A + long[np.minimum(first + 128, end - 128)]
    context = mixed(mixed(context) * _B + long[end - 128]) + (size * 512 + place - first).astype(np.uint64)
    return first, size, place - first, grams[place], mixed(context)


def _scans(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, valid starts, text number and place of each byte) of about SEGMENT bytes each."""
    parts, size = [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(0, len(t) - LENGTH + 1), SEGMENT):
            piece = t[lo : lo + SEGMENT + LENGTH - 1]
            parts.append((i, lo, piece))
            size += len(piece)
            if size >= SEGMENT:
                yield _scan(parts)
                parts, size = [], 0
    if parts:
        yield _scan(parts)


def _scan(parts: list[tuple[int, int, bytes]]):
    c = np.frombuffer(b"".join(p for *_, p in parts), np.uint8)
    which, place = ragged(np.array([len(p) for *_, p in parts]))
    valid = place + LENGTH <= np.array([len(p) for *_, p in parts])[which]
    return c, valid, np.array([i for i, *_ in parts])[which], place + np.array([lo for _, lo, _ in parts])[which]


def _bytes(b: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in b.column("raw").to_pylist()]


def _anchored(rows: DataFrame) -> DataFrame:
    """(rid, rid2, place, gram, context); place packs start, size and anchor."""
    out = pa.schema([("rid", pa.int64()), ("rid2", pa.int64()), ("place", pa.int64()), ("gram", pa.int64()), ("context", pa.int64())])

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            ids = [np.asarray(b.column(c)) for c in RID]
            for c, valid, which, place in _scans(_bytes(b)):
                first, size, reach, gram, context = anchors(c, valid)
                yield batch_of(out, (*[rid[which[first]] for rid in ids], (place[first] << 20) + (size << 10) + reach, gram.view(np.int64), context.view(np.int64)))

    return rows.select(*RID, "raw").where(F.length("raw") >= LENGTH).mapInArrow(part, "rid long, rid2 long, place long, gram long, context long")


_SIZE, _START = "cast((place >> 10) & 1023 as int)", "cast(place >> 20 as int)"


# ---- deep-shallow sorting --------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings with long common prefixes: inner nodes know a position and the bytes there only."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None  # a leaf is a list of equal strings, a node (position, {byte: child})

    @staticmethod
    def _byte(s: bytes, at: int) -> int:
        return s[at] if at < len(s) else -1

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):  # blindly to some leaf
            at, kids = node
            node = kids.get(self._byte(s, at)) or next(iter(kids.values()))
        other = self.strings[node[0]]
        common = _common(s, other)
        if common == len(s) == len(other):
            node.append(i)
            return
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < common:
            above, node = node, node[1][self._byte(s, node[0])]
        if isinstance(node, tuple) and node[0] == common:
            node[1][self._byte(s, common)] = [i]
            return
        new = (common, {self._byte(other, common): node, self._byte(s, common): [i]})
        if above is None:
            self.root = new
        else:
            above[1][self._byte(s, above[0])] = new

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(string, common prefix with the one before) in order; -1 for the first."""
        stack, common = [(self.root, -1)], -1
        while stack:
            node, common = stack.pop()
            if isinstance(node, tuple):
                kids = sorted(node[1].items(), reverse=True)
                stack += [(kid, node[0]) for _, kid in kids[:-1]]
                stack.append((kids[-1][1], common))
            else:
                for i in node:
                    yield i, common
                    common = len(self.strings[i])


def suffix_array(strings: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix of each with the one before it): by group, then by bytes; -1 where a group begins."""
    count = len(strings)
    width = 8 * SHALLOW
    heads = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), ">u8").astype(np.uint64).reshape(count, SHALLOW)
    at = np.argsort(groups, kind="stable")
    cut = np.flatnonzero(np.append(True, groups[at][1:] != groups[at][:-1]))
    order, common = [], []
    stack = [(at[lo:hi], 0) for lo, hi in zip(cut[::-1], np.append(cut[1:], count)[::-1], strict=True)]
    opened, before = set(groups.tolist()), None  # groups of which no string is out
    while stack:
        some, depth = stack.pop()
        if depth < SHALLOW and len(some) > 2:  # multikey quicksort: three ways around a pivot word
            words = heads[some, depth]
            pivot = words[len(words) // 2]
            for part, deeper in ((some[words > pivot], 0), (some[words == pivot], 1), (some[words < pivot], 0)):
                if len(part):
                    stack.append((part, depth + deeper))
            continue
        trie = BlindTrie(strings)
        for i in some.tolist():
            trie.add(i)
        for i, shared in trie.ordered():
            if int(groups[i]) in opened:
                opened.discard(int(groups[i]))
                shared = -1
            elif shared < 0:
                shared = _common(strings[before], strings[i])
            order.append(i)
            common.append(shared)
            before = i
    return np.array(order), np.array(common)


def repeated(contexts: list[bytes], reach: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For each context and each window start in it: whether the window occurs in another context of the group.

    reach: where the anchor lies.  Windows are numbered by the anchor's place in them.
    """
    rights = [c[r : r + LENGTH] for c, r in zip(contexts, reach, strict=True)]
    lefts = [c[:r][::-1] for c, r in zip(contexts, reach, strict=True)]
    n = len(contexts)
    sides = []
    for strings in (rights, lefts):
        order, common = suffix_array(strings, groups)
        sides.append((order, common))
    right, left = np.array(list(map(len, rights))), reach
    found = np.zeros((n, _WINDOW), bool)
    for back in range(_WINDOW):
        has = (left >= back) & (right >= LENGTH - back)
        if np.count_nonzero(has) < 2:
            continue
        kinds = []
        for (order, common), depth in zip(sides, (LENGTH - back, back), strict=True):
            kind = np.empty(n, np.int64)
            kind[order] = np.cumsum(common < depth)
            kinds.append(kind)
        which = np.flatnonzero(has)
        _, same, times = np.unique(kinds[0][which] * (n + 1) + kinds[1][which], return_inverse=True, return_counts=True)
        found[which, back] = times[same] > 1
    return found


def _ranges(starts: np.ndarray) -> list[dict]:
    """Bytes covered by windows at these sorted starts, as ranges."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LENGTH)
    return [{"lo": int(a), "hi": int(b) + LENGTH} for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)], strict=True)]


# ---- the edges of repeated passages ----------------------------------------

_RANGE = "array<struct<lo: int, hi: int>>"
_RANGE_PA = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _edges(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(gram, context, reach, bytes) of the asked contexts, cut from their texts."""
    out = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("crowded", pa.bool_()), ("reach", pa.int32()), ("bytes", pa.binary())])

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for raw, wanted in zip(_bytes(b), b.column("asked").to_pylist(), strict=True):
                cuts = [(x["place"] >> 20, x["place"] >> 10 & 1023, x["place"] & 1023) for x in wanted]
                yield batch_of(out, ([x["gram"] for x in wanted], [x["context"] for x in wanted], [x["crowded"] for x in wanted], [r for *_, r in cuts], [raw[s : s + n] for s, n, _ in cuts]))

    wanted = asked.groupBy(*RID).agg(F.collect_list(F.struct("gram", "context", "crowded", "place")).alias("asked"))  # no more than a text has
    texts = rows.select(*RID, "raw").where(sieved("rid", sieve(wanted, "rid"))).dropDuplicates([*RID])
    return texts.join(wanted, [*RID]).mapInArrow(part, "gram long, context long, crowded boolean, reach int, bytes binary")


def _sorted_edges(edges: DataFrame) -> DataFrame:
    """(gram, context, ranges) by deep-shallow sorting; ranges count from the start of the context."""
    out = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("ranges", _RANGE_PA)])

    def done(held: list[tuple]) -> pa.RecordBatch:
        gram, context, reach, raw = (list(x) for x in zip(*held, strict=True))
        reach = np.array(reach)
        found = repeated(raw, reach, np.unique(np.array(gram), return_inverse=True)[1])
        return batch_of(out, (gram, context, [_ranges((r - np.flatnonzero(f))[::-1]) for r, f in zip(reach, found, strict=True)]))

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches(it):
            for row in zip(*(b.column(c).to_pylist() for c in ("gram", "context", "reach", "bytes")), strict=True):
                if len(held) >= SORTED and held[-1][0] != row[0]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    rows = edges.where("not crowded").select("gram", "context", "reach", "bytes")
    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(part, f"gram long, context long, ranges {_RANGE}")


def _counted_edges(edges: DataFrame) -> DataFrame:
    """The same for crowded grams: windows are counted, not gathered."""
    out = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("reach", pa.int32()), ("back", pa.int32()), ("window", pa.binary())])

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for gram, context, reach, raw in zip(*(b.column(c).to_pylist() for c in ("gram", "context", "reach", "bytes")), strict=True):
                n = len(raw) - LENGTH + 1
                yield batch_of(out, ([gram] * n, [context] * n, [reach] * n, [reach - s for s in range(n)], [xxhash.xxh3_128_digest(raw[s : s + LENGTH]) for s in range(n)]))

    def ranges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("ranges", _RANGE_PA)])
        for b in batches(it):
            yield batch_of(kind, (b.column("gram"), b.column("context"), [_ranges(np.array(sorted(s))) for s in b.column("starts").to_pylist()]))

    rows = edges.where("crowded").select("gram", "context", "reach", "bytes")
    rows = rows.mapInArrow(windows, "gram long, context long, reach int, back int, window binary")
    often = rows.groupBy("gram", "back", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    starts = rows.join(often, ["gram", "back", "window"]).groupBy("gram", "context").agg(F.collect_set(F.expr("reach - back")).alias("starts"))
    return starts.mapInArrow(ranges, f"gram long, context long, ranges {_RANGE}")


def spans(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(rid, rid2, spans): the covered bytes of each text in ``rows`` (rid, rid2, raw), as ranges that may overlap."""
    found = _anchored(rows)
    often = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    found = spread(found, "gram").join(spread(often, "gram"), ["gram", SPREAD], "left_semi").drop(SPREAD)
    # a repeated row has the places of the first: one row with the number of them
    found = stored(found.groupBy(*RID, "place", "gram", "context").agg(F.count(F.lit(1)).alias("times")), "anchors")
    contexts = found.groupBy("gram", "context").agg(F.sum("times").alias("times"), F.min(F.struct(*RID, "place")).alias("at"))
    contexts = stored(contexts, "contexts")
    mixed_grams = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    asked = spread(contexts, "gram").join(spread(mixed_grams, "gram"), ["gram", SPREAD]).select("gram", "context", (F.col("kinds") > crowd).alias("crowded"), "at.rid", "at.rid2", "at.place")
    edges = stored(_edges(asked, rows), "edges")
    partly = _sorted_edges(edges).union(_counted_edges(edges)).where(F.size("ranges") > 0)
    wholly = contexts.where("times > 1").select("gram", "context", F.lit(True).alias("whole"))
    covered = wholly.join(partly, ["gram", "context"], "full")
    keys = ["gram", "context"]
    places = spread(found, *keys).join(spread(covered, *keys), [*keys, SPREAD])
    ranges = F.when(F.col("whole"), F.array(F.struct(F.lit(0).alias("lo"), F.expr(_SIZE).alias("hi")))).otherwise(F.col("ranges"))
    one = places.select(*RID, F.expr(_START).alias("start"), F.explode(ranges).alias("r"))
    return one.groupBy(*RID).agg(F.collect_list(F.struct((F.col("start") + F.col("r.lo")).alias("lo"), (F.col("start") + F.col("r.hi")).alias("hi"))).alias("spans"))


def _cut(rows: DataFrame) -> DataFrame:
    """``rows`` with spans made disjoint and maximal, and ``kept``: the bytes outside them."""

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            all_spans, kept = [], []
            for raw, ranges in zip(_bytes(b), b.column("spans").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for lo, hi in sorted((x["lo"], x["hi"]) for x in ranges or []):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(hi, merged[-1][1])
                    else:
                        merged.append([lo, hi])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
                all_spans.append([{"lo": a, "hi": z} for a, z in merged])
            columns = [pa.array(all_spans, _RANGE_PA) if f.name == "spans" else b.column(f.name) for f in b.schema]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())], [*b.schema.names, "kept"])

    return rows.mapInArrow(part, added(rows, "kept", "binary"))


def deduplicated(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """All columns of ``docs``, ``spans`` (bytes removed: disjoint, maximal, in order) and ``kept`` (the other bytes)."""
    docs = without(docs, "spans", "kept")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw")
    numbers = [F.xxhash64("doc_id", "text").alias("rid"), F.xxhash64(F.lit("rid2"), "text", "doc_id").alias("rid2")]
    rows = docs.select(F.struct(*docs.columns).alias("doc"), raw, *numbers)  # whatever the columns are called
    covered = stored(spans(rows, crowd), "spans")
    rows = rows.withColumn("maybe", sieved("rid", sieve(covered, "rid")))
    joined = rows.where("maybe").join(covered, [*RID], "left").select("doc", "raw", "spans")
    rest = rows.where("not maybe").select("doc", "raw", F.lit(None).cast(_RANGE).alias("spans"))
    return _cut(joined.unionByName(rest)).select("doc.*", "spans", "kept")
