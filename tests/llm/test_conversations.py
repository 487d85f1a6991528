"""Conversation repair against trying every edit, and damage against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from whence.llm import conversations as cv
from whence.llm.queries import op12_conversation_repair

ROWS = "conv_id long, turn long, role string, text string"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def marks(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        ink = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, wrong):
    """(cost, audit, repaired lines) by trying all edits, shortest suffixes first."""
    n, best = len(rows), {}
    for i in range(n, -1, -1):
        for q in ("", "s", "u", "a"):
            best[i, q] = (0, "", ()) if i == n and q in ("", "a") else (1 << 40, "", ())
        for _ in range(4):
            for q in ("", "s", "u", "a"):
                options = [best[i, q]]
                to = "a" if q == "u" else "u"
                name = {"a": "assistant", "u": "user"}[to]
                cost, audit, left = best[i, to]
                options.append((5 + cost, "I" + audit, (f"{name}:", *left)))
                if i < n:
                    (_, _, role, text), extra = rows[i], 5 * (wrong[i] == "truncated")
                    cost, audit, left = best[i + 1, q]
                    options.append((2 + cost, "D" + audit, left))
                    if wrong[i] in ("", "truncated"):
                        cost, audit, left = best[i + 1, to]
                        options.append((1 + extra + cost, "R" + audit, (f"{name}:{text}", *left)))
                        if (q, role[:1]) in AFTER:
                            cost, audit, left = best[i + 1, role[:1]]
                            options.append((extra + cost, "K" + audit, (f"{role}:{text}", *left)))
                best[i, q] = min(options)
    return best[0, ""]


def tie(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def brute(original):
    out = []
    damaged = damage(original)
    for conv in {r[0] for r in original}:
        rows = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], tie(r[3])))
        wrong, turns = marks(rows), {r[1] for r in rows} - {None}
        heads = [r[2][:1] for r in rows]
        cost, audit, left = cheapest(rows, wrong)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(wrong.count(k) for k in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def chats(seed, n, longest=7):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, turn if rnd.random() < 0.95 else None, role, rnd.choice(["Yes.", "no", "", " \n", "Why?", "well!", f"{turn} ok.", f"{turn} and", None, "\xa0"])))
    return rows


@pytest.mark.parametrize("segment, n, longest", [(128, 250, 8), (2, 120, 14), (5, 3, 150)])
def test_repairs_match_trying_every_edit(spark, monkeypatch, segment, n, longest):
    monkeypatch.setattr(cv, "SEGMENT", segment)
    rows = chats(segment, n, longest) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (None, 2, "assistant", "Hi."), (10**6, None, "user", "Lost.")]
    df = spark.createDataFrame(rows, ROWS).withColumn("gone", F.lit("mine")).withColumn("open", F.lit("mine")).withColumn("cost", F.lit(1))
    got = sorted((tuple(r) for r in cv.digests(cv.damaged(df)).collect()), key=repr)
    assert got == brute(rows)


def test_rows_of_repaired_conversations(spark, monkeypatch):
    monkeypatch.setattr(cv, "SEGMENT", 2)
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Who?"), (1, 2, "assistant", "Me."), (1, 3, "user", "And"), (2, 5, "assistant", "Yes.")]
    got = [tuple(r) for r in cv.turns(spark.createDataFrame(rows, ROWS)).orderBy("conv_id", "at").collect()]
    want = cheapest(rows[:4], marks(rows[:4]))
    assert [f"{r[2]}:{r[3]}" for r in got if r[0] == 1] == list(want[2])
    assert [r[1] for r in got if r[0] == 1] == list(range(1, len(want[2]) + 1))


def test_conversations_without_rows_and_empty_tables(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, gone, "user", "Hi.")], ROWS)
    assert [tuple(r) for r in cv.digests(cv.damaged(df)).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cv.digests(cv.damaged(df.limit(0))).count() == 0


def test_prices_are_an_optimal_dual():
    rnd = random.Random(2)
    for _ in range(200):
        n = rnd.randint(0, 12)
        roles = [rnd.choice(["user", "assistant", "system", "x"]) for _ in range(n)]
        wrong = [rnd.choice(["", "", "", "truncated", "blank"]) for _ in range(n)]
        exits = [5 * k for k in cv._MISSING]
        arcs, prices = cv.lattice(roles, wrong, exits), cv.start_prices(wrong, exits)
        cost = cv.auction(arcs, prices, 0)
        assert all(prices[i] <= c + prices[j] for i, out in enumerate(arcs) for c, _, j in out)
        audit, _ = cv.traced(arcs, prices, 0)
        assert cost == prices[0] - prices[-1] == cheapest([(0, 0, r, "") for r in roles], wrong)[0]
        assert audit.count("I") + n - audit.count("D") >= 0


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in op12_conversation_repair(spark, sf).collect()), key=repr) == brute(rows)
