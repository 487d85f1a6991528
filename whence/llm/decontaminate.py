"""Benchmark decontamination by the q-gram lemma: which documents hold a benchmark item, up to edits.

An item of m characters leaks if a stretch of the document is within k = m // 10 edits of it.
Such a stretch keeps at least m + 1 - q (k + 1) of the item's q-grams, and they lie on k + 1
neighbouring diagonals (position in the text minus position in the item).  Shared q-grams are
counted in bands of diagonals that overlap by k, so one band has all of them; bands that reach
the bound are verified by banded alignment, which also gives the span and its edits.

The benchmark is a query set: it goes through the driver in blocks of at most ``BLOCK``
characters, each block's index is sent to the tasks, and the documents pass them one by one.
Letters are compared in lower case, every white space character as a space.  Items under
``LEAST`` characters, without white space at their ends, leak where they occur exactly, from one
word boundary to another; without a letter or digit they are not looked for.  In scripts without
spaces every character is a word.  Of equal items the first id is reported.  Null and empty texts have no leaks; an empty benchmark finds none.  Spans count the
text's code points.  An existing column ``leaks`` is replaced, or the result can
be given another name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from whence.llm.common import added, batches, free_name, mixed, ragged, texts, without

#: Share of edits; shortest item that may have edits; characters of benchmark in a pass; q-gram lengths, the longest that leaves a bound is used.
EDITS, LEAST, BLOCK, QS = 0.1, 20, 2_000_000, (8, 4)
_LEAK = "array<struct<item_id: bigint, start: int, end: int, edits: int>>"
_SPACES = np.array([chr(i).isspace() for i in range(0x3001)] + [False])


def codes(text: str) -> np.ndarray:
    """Code points in lower case, white space as spaces; as many as the text has."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    c = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_SPACES[np.minimum(c, len(_SPACES) - 1)], np.uint32(32), c)


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams, q a power of two."""
    h = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    n = 1
    while n < q and len(h) > n:
        h = h[:-n] * np.uint64(0xBF58476D1CE4E5B9 + 2 * n) + h[n:]
        n *= 2
    return mixed(h) if n >= q else h[:0]


def _bound(m: int, k: int, q: int) -> int:
    return m + 1 - q * (k + 1)


class Index:
    """The q-grams of the items that use one q."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int):
        self.q, self.ids, self.patterns = q, [i for i, _ in items], [p for _, p in items]
        sizes = np.array([len(p) for p in self.patterns])
        self.edits = (sizes * EDITS).astype(np.int64)
        self.least = _bound(sizes, self.edits, q)
        h = [grams(p, q) for p in self.patterns]
        which, place = ragged(np.array([len(x) for x in h]))
        order = np.argsort(h := np.concatenate(h), kind="stable")
        self.keys, self.first, self.times = np.unique(h[order], return_index=True, return_counts=True)
        self.item, self.place = which[order], place[order]
        bits = max(12, int(16 * len(self.keys)).bit_length())
        self.shift, self.flags = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.flags[self.keys >> self.shift] = True

    def regions(self, c: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, lowest and highest diagonal in the document) of bands that reach the bound.

        c: documents end to end, each followed by a character no item has; starts: where they begin.
        """
        h = grams(c, self.q)
        at = np.flatnonzero(self.flags[h >> self.shift])
        h = h[at]
        key = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        real = self.keys[key] == h
        at, key = at[real], key[real]
        which, nth = ragged(self.times[key])
        entry, at = self.first[key][which] + nth, at[which]
        if not len(at):
            return
        doc, item = np.searchsorted(starts, at, "right") - 1, self.item[entry]
        pair = doc * len(self.ids) + item
        if len(starts) * len(self.ids) <= 1 << 24:  # a pair with too few hits in all has no band with enough
            keep = (np.bincount(pair) >= np.resize(self.least, (doc[-1] + 1) * len(self.ids))[: pair.max() + 1])[pair]
            doc, item, at, entry, pair = doc[keep], item[keep], at[keep], entry[keep], pair[keep]
            if not len(at):
                return
        step = self.edits[item] + 1
        diagonal = at - starts[doc] - self.place[entry] + int(max(map(len, self.patterns)))  # not below 0
        band = diagonal // step
        wide = int(band.max()) + 2
        group = pair * wide + band
        found, count = np.unique(np.concatenate([group, group[band > 0] - 1]), return_counts=True)
        pair, band = np.divmod(found, wide)
        doc, item = np.divmod(pair, len(self.ids))
        keep = count >= self.least[item]
        for d, i, b in zip(doc[keep].tolist(), item[keep].tolist(), band[keep].tolist(), strict=True):
            low = b * int(self.edits[i] + 1) - max(map(len, self.patterns))
            yield d, i, low, low + 2 * int(self.edits[i])


def aligned(
    pattern: np.ndarray, text: np.ndarray, low: int, high: int, anchored: bool = False, most: int | None = None
) -> tuple[int, int]:
    """(edits, end) of the best alignment of the pattern to a stretch of text within diagonals low to high.

    The stretch starts anywhere in the text, or at its beginning if anchored.  With ``most`` the
    alignment may be given up as soon as it needs more edits.
    """
    t = np.arange(high - low + 1)
    far = len(pattern) + len(text) + 1
    j = low + t
    row = np.where(j == 0, 0, np.where((j < 0), far, j)) if anchored else np.where((j < 0) | (j > len(text)), far, 0)
    padded = np.full(len(pattern) + len(t) + 2, 0xFFFFFFFF, np.uint32)
    lo, hi = max(0, low), min(len(text), low + len(padded))
    if hi > lo:
        padded[lo - low : hi - low] = text[lo:hi]
    for i, p in enumerate(pattern):
        moved = row + (padded[i : i + len(t)] != p)
        moved[:-1] = np.minimum(moved[:-1], row[1:] + 1)
        row = np.minimum.accumulate(moved - t) + t
        if most is not None and i % 8 == 7 and row.min() > most:
            return most + 1, 0
    row = np.where((j + len(pattern) < 0) | (j + len(pattern) > len(text)), far, row)
    best = int(np.argmin(row))
    return int(row[best]), int(j[best] + len(pattern))


def spans(index: Index, item: int, text: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the item in a band, if within its edits."""
    pattern, k = index.patterns[item], int(index.edits[item])
    m = len(pattern)
    whole = text[max(0, low) : max(0, high + m)]
    exact = whole.tobytes().find(pattern.tobytes())
    if exact >= 0 and exact % 4 == 0:
        start = max(0, low) + exact // 4
        return start, start + m, 0
    edits, end = aligned(pattern, text, low - k, high + k, most=k)
    if edits > k:
        return None
    _, back = aligned(pattern[::-1], text[:end][::-1], -k, k, anchored=True)
    return end - back, end, edits


#: Scripts without spaces: first and last code points.
_DENSE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


@lru_cache(1)
def _kinds() -> np.ndarray:
    """By code point: 0 outside words, 1 inside words, 2 a word of its own."""
    kinds = np.fromiter((chr(i).isalnum() for i in range(0x110000)), np.uint8, 0x110000)
    for lo, hi in _DENSE:
        kinds[lo : hi + 1] *= 2
    return np.append(kinds, np.uint8(0))  # the gap between documents


class Short:
    """Items that are found exactly, between word boundaries."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items: dict[int, dict[bytes, int]] = {}
        for i, c in items:
            self.items.setdefault(len(c), {})[c.tobytes()] = i
        self.hashes = {m: np.sort(self._hash(np.array([np.frombuffer(x, np.uint32) for x in own]))) for m, own in self.items.items()}

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            h = mixed(h + rows[:, k] + np.uint64(1))
        return h

    def found(self, c: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) in one document, in order of the items' lengths."""
        kind = _kinds()[np.minimum(c, 0x110000)]
        edge = np.append(np.insert((kind[1:] != 1) | (kind[:-1] != 1), 0, True), True) if len(c) else np.zeros(0, bool)
        for m, own in self.items.items():
            start = np.flatnonzero(edge[:-m] & edge[m:]) if len(c) >= m else np.zeros(0, np.int64)
            for at in range(0, len(start), 1 << 16):
                s = start[at : at + (1 << 16)]
                h = self._hash(c[s[:, None] + np.arange(m)])
                key = np.minimum(np.searchsorted(self.hashes[m], h), len(own) - 1)
                for x in s[self.hashes[m][key] == h].tolist():
                    if (i := own.get(c[x : x + m].tobytes())) is not None:
                        yield i, x, x + m


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    block, size, known = [], 0, set()
    for r in benchmark.selectExpr("cast(item_id as long) item_id", "text").where("item_id is not null").orderBy("item_id").toLocalIterator():
        c = codes(r.text or "")
        if len(c) < LEAST:
            solid = np.flatnonzero(c != 32)
            c = c[solid[0] : solid[-1] + 1] if len(solid) else c[:0]
            if not _kinds()[np.minimum(c, 0x110000)].any():
                continue
        if size + len(c) > BLOCK and block:
            yield block
            block, size, known = [], 0, set()
        if (mark := c.tobytes()) not in known:
            known.add(mark)
            block.append((r.item_id, c))
            size += len(c)
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, out: str = "leaks") -> DataFrame:
    """All columns of ``docs`` and ``out``: the items found in the text, with spans and edits."""
    docs = without(docs, out)
    found = docs.selectExpr("*", f"cast(array() as {_LEAK}) `{out}`")
    for block in _blocks(benchmark):
        short = [x for x in block if len(x[1]) < LEAST]
        block = [x for x in block if len(x[1]) >= LEAST]
        parts = []
        for q in QS:
            fits = lambda p, q=q: _bound(len(p), int(len(p) * EDITS), q) >= 2
            taken = [x for x in block if fits(x[1]) and not any(fits(x[1], r) for r in QS if r > q)]
            parts += [Index(taken, q)] if taken else []
        found = found.mapInArrow(_pass(parts, Short(short) if short else None, out), added(docs, out, _LEAK))
    return found


def _pass(parts: list[Index], short: Short | None, out: str):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            found = [x or [] for x in b.column(out).to_pylist()]
            pieces = [codes(t) for t in texts(b)]
            starts = np.cumsum([0, *(len(p) + 1 for p in pieces)])[:-1]
            gap = np.array([0xFFFFFFFF], np.uint32)
            c = np.concatenate([x for p in pieces for x in (p, gap)])
            for index in parts:
                last = None
                for d, i, low, high in index.regions(c, starts):
                    span = spans(index, i, pieces[d], low, high)
                    if span and not (last and last[:2] == (d, i) and span[0] < last[2]):  # else a neighbouring band found it
                        last = (d, i, span[1])
                        found[d].append({"item_id": index.ids[i], "start": span[0], "end": span[1], "edits": span[2]})
            for d, c in enumerate(pieces if short else []):
                found[d] += [{"item_id": i, "start": lo, "end": hi, "edits": 0} for i, lo, hi in short.found(c)]
            at = b.schema.get_field_index(out)
            yield b.set_column(at, b.schema.field(at).name, pa.array(found, kind))

    return part


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without leaks."""
    out = free_name(docs, "leaks")
    return leaks(docs, benchmark, out).where(f"size(`{out}`) = 0").drop(out)
