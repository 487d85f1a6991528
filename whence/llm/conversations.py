"""Conversation structure repair: cheapest edits to ``system? (user assistant)+``, found by the auction shortest-path algorithm.

A conversation's rows, by turn, are a lattice: a node is (rows taken, state of the dialogue), an arc is an
edit.  Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert an empty user or assistant row 5; a row that is
truncated costs 5 more unless deleted; blank and duplicate rows can only be deleted.  The auction keeps a price for every
node and one path: the path grows along an arc whose cost is the price difference, or else the last node's price rises and the
path shrinks by it.  When it reaches the end, the prices are an optimal dual: an arc is on a cheapest path only if it
is tight.  Tracing the tight arcs in the order Delete, Insert, Keep, Rerole gives, of all cheapest edits, those whose
initials come first.

Rows are dealt by ranges of (conversation, turn, ...), never by conversation, and packed into segments of at most
``SEGMENT`` rows; most conversations are one segment.  Of the others every segment becomes a 4 x 4 table of
costs between its ends; these (64 bytes a segment, less than its audit) give the price of each seam, with which the segments
are solved alone and joined by the state at their seams.  Only the digest of a whole conversation reads its
segments one after the other, as a stream.

Null roles and texts are one space, and so are null ids and turns inside ``damaged``'s key; rows with a null conv_id are one
conversation; null turns come first.  Rows of one turn are taken by role, then by a hash of the text; repeated rows are
duplicates.  A conversation without rows left costs 0 and has an empty audit.  Texts of any length are whole; empty
tables give an empty result.  Only ``conv_id``, ``turn``, ``role`` and ``text`` are read, other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whence.llm.common import batch_of, batches, spread, trim
from whence.session import stored

#: Rows and characters of a segment; a longer row is a segment alone.
SEGMENT, SEGMENT_CHARS = 128, 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant; the state after a role's initial.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: What is missing at the end in each state, in inserted rows.
_MISSING = (0, 2, 1, 0)
_ROLES = {"u": "user", "a": "assistant"}
_NEXT = ("u", "u", "a", "u")
_INK = re.compile(r"[^\x20\x09-\x0D]")
_NEVER = 1 << 30


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by a hash of their key; a dropped row stays with ``gone``, so that its conversation is known."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(part("role")).alias("role"),
        text.alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


# ---- the lattice of a segment ------------------------------------------------


def faults(roles: list[str], texts: list[str], known: set[int]) -> list[str]:
    """First fault of every row: blank, duplicate, truncated or none; ``known`` are duplicates of earlier segments."""
    seen, out = set(), []
    for i, (role, text) in enumerate(zip(roles, texts)):
        ink = _INK.search(text)
        again = (role, text) in seen or i in known
        seen.add((role, text))
        if ink is None:
            out.append("blank")
        elif again:
            out.append("duplicate")
        else:
            last = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1]
            out.append("" if last in ".!?" else "truncated")
    return out


def lattice(roles: list[str], wrong: list[str], exits: list[int]) -> list[list[tuple[int, str, int]]]:
    """Arcs (cost, initial of the edit, node) out of every node 4 * rows + state; the last node is the end.

    ``exits`` are the prices of the states after the last row.  Nodes that can't reach the end have no arcs.
    """
    n = len(roles)
    end = 4 * n + 4
    out: list[list[tuple[int, str, int]]] = [[] for _ in range(end + 1)]
    alive = [False] * (end + 1)
    for q in range(4):
        if exits[q] < _NEVER:
            out[4 * n + q].append((exits[q], "", end))
            alive[4 * n + q] = True
    for i in range(n - 1, -1, -1):
        forced, extra, initial = wrong[i] in ("blank", "duplicate"), TRUNCATED if wrong[i] == "truncated" else 0, roles[i][:1]
        here, there = 4 * i, 4 * i + 4
        for q in range(4):
            arcs = out[here + q]
            if alive[there + q]:
                arcs.append((DELETE, "D", there + q))
            if not forced:
                if (to := _AFTER[q].get(initial)) is not None and alive[there + to]:
                    arcs.append((KEEP + extra, "K", there + to))
                to = _AFTER[q][_NEXT[q]]
                if alive[there + to]:
                    arcs.append((REROLE + extra, "R", there + to))
            alive[here + q] = bool(arcs)
        for q in (ASSISTANT, USER, ASSISTANT, SYSTEM, NOTHING):
            to = here + _AFTER[q][_NEXT[q]]
            if alive[to] and all(label != "I" for _, label, _ in out[here + q]):
                out[here + q].append((INSERT, "I", to))
                alive[here + q] = True
    return out


def start_prices(wrong: list[str], exits: list[int]) -> list[int]:
    """Prices that no arc undercuts: what the rows cost at least, whatever the roles."""
    least, prices = min(exits), []
    for w in reversed(wrong):
        prices.append(least)
        least += DELETE if w else KEEP
    return [p for p in (least, *reversed(prices)) for _ in range(4)] + [0]


def auction(arcs: list[list[tuple[int, str, int]]], prices: list[int], origin: int) -> int:
    """Raise ``prices`` until a path of tight arcs leads from the origin to the end; its cost."""
    end = len(arcs) - 1
    path = [origin]
    while (node := path[-1]) != end:
        best, to = min((cost + prices[j], j) for cost, _, j in arcs[node])
        if prices[node] < best:
            prices[node] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return prices[origin]


def traced(arcs: list[list[tuple[int, str, int]]], prices: list[int], origin: int) -> tuple[str, int]:
    """The first path of tight arcs in the order of the edits' initials: (initials, last node before the end)."""
    end, dead = len(arcs) - 1, set()
    tight = lambda node: iter(sorted((label, j) for cost, label, j in arcs[node] if cost + prices[j] == prices[node]))
    path, labels, todo = [origin], [], [tight(origin)]
    while path[-1] != end:
        for label, j in todo[-1]:
            if j not in dead:
                path.append(j)
                labels.append(label)
                todo.append(tight(j))
                break
        else:
            dead.add(path.pop())
            todo.pop()
            labels.pop()
    return "".join(labels), path[-2]


def crossing(roles: list[str], wrong: list[str]) -> np.ndarray:
    """4 x 4 costs from each state before the rows to each state after them."""
    out = np.full((4, 4), _NEVER, np.int32)
    for q in range(4):
        exits = [0 if k == q else _NEVER for k in range(4)]
        arcs, prices = lattice(roles, wrong, exits), start_prices(wrong, exits)
        for entry in range(4):
            if arcs[entry]:
                out[entry, q] = auction(arcs, prices, entry)
    return out


def solved(roles: list[str], wrong: list[str], exits: list[int], last: bool, entries: range = range(1)) -> list[tuple[str, int, int]]:
    """(initials, cost, state after the rows) for every entry state; ("", never, never) where there is no way."""
    arcs, prices = lattice(roles, wrong, exits), start_prices(wrong, exits)
    out = []
    for entry in entries:
        if not arcs[entry]:
            out.append(("", _NEVER, _NEVER))
            continue
        cost = auction(arcs, prices, entry)
        labels, node = traced(arcs, prices, entry)
        state = node - 4 * len(roles)
        out.append((labels + "I" * _MISSING[state] * last, cost - exits[state] * (not last), state))
    return out


def applied(roles: list[str], texts: list[str], audit: str, state: int) -> list[dict]:
    """The rows that the edits leave."""
    out, i = [], 0
    for edit in audit:
        role = _ROLES[_NEXT[state]] if edit in "RI" else roles[i]
        if edit != "D":
            out.append({"role": role, "text": "" if edit == "I" else texts[i]})
            state = _AFTER[state][role[0]]
        i += edit != "I"
    return out


# ---- segments ---------------------------------------------------------------

_PACKED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int32()), ("open", pa.bool_()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_PACKED_DDL = "conv_id long, part int, seg int, open boolean, turns array<long>, roles array<string>, texts array<string>"


def segments(rows: DataFrame) -> DataFrame:
    """Rows in order, packed; ``open`` segments may not be the whole of their conversation."""

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seg = TaskContext.get().partitionId(), 0
        conv: tuple = ()
        lead, cut, size = True, False, 0  # first conversation of the part; conversation already cut
        held: tuple[list, list, list] = ([], [], [])
        ready: list[tuple] = []

        def close(is_open: bool) -> None:
            nonlocal seg, held, size
            ready.append((*conv, number, seg, is_open, *held))
            seg, held, size = seg + 1, ([], [], []), 0

        for b in batches(it):
            for conv_id, turn, role, text, gone in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone"))):
                if conv != (conv_id,):
                    if conv:
                        close(lead or cut)
                        lead = False
                    conv, cut = (conv_id,), False
                if gone:
                    continue
                if held[0] and (len(held[0]) >= SEGMENT or size + len(text) > SEGMENT_CHARS):
                    cut = True
                    close(True)
                size += len(text)
                for column, value in zip(held, (turn, role, text)):
                    column.append(value)
            if ready:
                yield batch_of(_PACKED, [list(c) for c in zip(*ready)])
                ready.clear()
        if conv:
            close(True)
            yield batch_of(_PACKED, [list(c) for c in zip(*ready)])

    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), "gone")
    order = ("conv_id", "turn", "role", "tie")
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.drop("tie").mapInArrow(part, _PACKED_DDL), "segments")


def known_duplicates(parts: DataFrame) -> DataFrame:
    """Open segments with ``known``: the places of rows that an earlier segment of the conversation has too."""
    rows = parts.select("conv_id", "part", "seg", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.octet_length("row.roles").cast("string"), "row.roles", "row.texts")
    rows = rows.select("part", "seg", "at", F.md5(name).alias("name"))
    place = F.struct("part", "seg")
    groups = rows.groupBy("name").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    again = spread(rows, "name").join(spread(groups, "name"), ["name", "_spread"]).where(F.struct("part", "seg") > F.col("first"))
    places = again.groupBy("part", "seg").agg(F.collect_list("at").alias("known"))  # at most a segment's rows
    return parts.join(places, ["part", "seg"], "left").withColumn("known", F.coalesce("known", F.array().cast("array<int>")))


_MENDED_DDL = (
    "conv_id long, part int, seg int, n int, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "head string, tail string, lo long, hi long, distinct long, turns array<struct<role:string,text:string>>"
)
_MENDED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int32()), ("n", pa.int32()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()),
                     ("head", pa.string()), ("tail", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("distinct", pa.int64()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])


def _mended(conv_id, part: int, seg: int, turns: list, roles: list[str], texts: list[str], wrong: list[str], audit: str, cost: int, entry: int) -> tuple:
    initials = [r[:1] for r in roles]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    known = [t for t in turns if t is not None]
    return (conv_id, part, seg, len(roles), wrong.count("blank"), wrong.count("duplicate"), wrong.count("truncated"), illegal, cost, audit, *((initials[0], initials[-1]) if roles else ("", "")),
            known[0] if known else None, known[-1] if known else None, len(set(known)), applied(roles, texts, audit, entry))


def _rows(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(b.column(c).to_pylist() for c in names))


_SEGMENT = ("conv_id", "part", "seg", "turns", "roles", "texts")


def closed(parts: DataFrame) -> DataFrame:
    """Whole conversations, repaired."""
    ends = [INSERT * n for n in _MISSING]

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            out = []
            for conv_id, p, seg, turns, roles, texts in _rows(b, *_SEGMENT):
                wrong = faults(roles, texts, set())
                ((audit, cost, _),) = solved(roles, wrong, ends, True)
                out.append(_mended(conv_id, p, seg, turns, roles, texts, wrong, audit, cost, NOTHING))
            yield batch_of(_MENDED, [list(c) for c in zip(*out)])

    return parts.select(*_SEGMENT).mapInArrow(part, _MENDED_DDL)


def seams(tables: DataFrame) -> DataFrame:
    """(part, seg, exits, last): of every segment the prices of the states after it, from the tables of its conversation."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "seg"], ascending=False, ignore_index=True)
        price, out = np.array([INSERT * n for n in _MISSING], np.int64), []
        for m in pdf["costs"]:
            out.append(price.tolist())
            price = np.minimum((np.frombuffer(m, np.int32).reshape(4, 4) + price).min(axis=1), _NEVER)
        trim()
        return pd.DataFrame({"part": pdf["part"], "seg": pdf["seg"], "exits": out, "last": pdf.index == 0})

    return tables.groupBy("conv_id").applyInPandas(chain, "part int, seg int, exits array<int>, last boolean")


def entries(options: DataFrame) -> DataFrame:
    """(part, seg, entry): the state before every segment, from the states that the segments before it end in."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "seg"], ignore_index=True)
        state, out = NOTHING, []
        for ends in pdf["ends"]:
            out.append(state)
            state = int(ends[state])
        trim()
        return pd.DataFrame({"part": pdf["part"], "seg": pdf["seg"], "entry": out})

    return options.groupBy("conv_id").applyInPandas(chain, "part int, seg int, entry int")


def chained(parts: DataFrame) -> DataFrame:
    """Conversations of several segments, repaired segment by segment."""
    parts = stored(known_duplicates(parts), "open-segments")
    table = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int32()), ("costs", pa.binary())])
    option = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int32()), ("audits", pa.list_(pa.string())), ("costs", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32()))])

    def cross(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            rows = [(c, p, s, crossing(r, faults(r, t, set(k))).tobytes()) for c, p, s, r, t, k in _rows(b, "conv_id", "part", "seg", "roles", "texts", "known")]
            yield batch_of(table, [list(c) for c in zip(*rows)])

    def solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            rows = []
            for c, p, s, roles, texts, known, exits, last in _rows(b, "conv_id", "part", "seg", "roles", "texts", "known", "exits", "last"):
                found = solved(roles, faults(roles, texts, set(known)), exits, last, range(4))
                rows.append((c, p, s, *map(list, zip(*found))))
            yield batch_of(option, [list(c) for c in zip(*rows)])

    def mend(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            out = []
            for conv_id, p, s, turns, roles, texts, known, entry, audits, costs in _rows(b, *_SEGMENT, "known", "entry", "audits", "costs"):
                out.append(_mended(conv_id, p, s, turns, roles, texts, faults(roles, texts, set(known)), audits[entry], costs[entry], entry))
            yield batch_of(_MENDED, [list(c) for c in zip(*out)])

    tables = parts.mapInArrow(cross, "conv_id long, part int, seg int, costs binary")
    priced = parts.join(seams(tables), ["part", "seg"])
    options = stored(priced.mapInArrow(solve, "conv_id long, part int, seg int, audits array<string>, costs array<long>, ends array<int>"), "segment-options")
    chosen = options.drop("conv_id").join(entries(options.select("conv_id", "part", "seg", "ends")), ["part", "seg"])
    return parts.join(chosen, ["part", "seg"]).mapInArrow(mend, _MENDED_DDL)


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole conversations, segments of the others) with faults, cost, audit and the rows that are left as ``turns``."""
    parts = segments(rows)
    return closed(parts.where("not open")), chained(parts.where("open"))


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the repaired conversations row by row, ``at`` from 1."""

    def earlier(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "seg"], ignore_index=True)
        return pd.DataFrame({"part": pdf["part"], "seg": pdf["seg"], "before": pdf["m"].cumsum() - pdf["m"]})

    one, several = repaired(rows)
    each = lambda df: df.select("conv_id", "part", "seg", F.posexplode("turns").alias("at", "x"))
    several = stored(several, "mended-segments")
    before = several.select("conv_id", "part", "seg", F.size("turns").alias("m")).groupBy("conv_id").applyInPandas(earlier, "part int, seg int, before long")
    several = each(several).join(before, ["part", "seg"]).select("conv_id", F.expr("at + 1 + before").alias("at"), "x.role", "x.text")
    return each(one).select("conv_id", F.expr("at + 1L").alias("at"), "x.role", "x.text").unionAll(several)


_DIGEST_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_DIGEST = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def digests(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps in its turns, faults, illegal neighbours, cost, audit, hash of the repaired rows."""
    one, several = repaired(rows)
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("distinct"), F.lit(0)).alias("gaps")
    sha = F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256")
    one = one.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", sha)

    def stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: tuple = ()
        done: list[tuple] = []

        def close() -> None:
            gaps = 0 if lo is None else hi - lo + 1 - distinct
            done.append((*conv, gaps, *sums, "".join(audit), sha.hexdigest()))

        for b in batches(it):
            for c, n, *five, edits, head, end, a, z, d, left in _rows(b, "conv_id", "n", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "head", "tail", "lo", "hi", "distinct", "turns"):
                if conv != (c,):
                    if conv:
                        close()
                    conv, sums, audit, sha, some = (c,), [0] * 5, [], hashlib.sha256(), False
                    tail, lo, hi, distinct = None, None, None, 0
                sums = [x + y for x, y in zip(sums, five)]
                if n:
                    sums[3] += tail is not None and tail + head not in ("su", "ua", "au")
                    tail = end
                if a is not None:
                    distinct += d - (hi == a)
                    lo, hi = a if lo is None else lo, z
                audit.append(edits)
                for t in left:
                    sha.update(("\n" if some else "").encode() + f"{t['role']}:{t['text']}".encode("utf-8", "surrogatepass"))
                    some = True
            if done:
                yield batch_of(_DIGEST, [list(x) for x in zip(*done)])
                done.clear()
        if conv:
            close()
            yield batch_of(_DIGEST, [list(x) for x in zip(*done)])

    order = several.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    return one.unionAll(order.mapInArrow(stream, _DIGEST_DDL))
