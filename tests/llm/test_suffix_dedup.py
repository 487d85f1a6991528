"""Repeated 200-byte strings against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_docs import awkward, prose, table
from whence.llm import suffix_dedup as sd
from whence.llm.queries import op2_suffix_dedup


def brute(texts):
    """For each text its covered bytes as a mask."""
    raw = [(t or "").encode() for t in texts]
    times = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    masks = []
    for t in raw:
        edge = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if times[t[i : i + 200]] > 1:
                edge[i] += 1
                edge[i + 200] -= 1
        masks.append(np.cumsum(edge)[: len(t)] > 0)
    return raw, masks


def check(df, texts):
    raw, masks = brute(texts)
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        mask = masks[r.doc_id]
        got = np.zeros(len(mask), bool)
        for s in r.spans:
            assert s.lo < s.hi and not got[max(0, s.lo - 1) : s.hi].any()
            got[s.lo : s.hi] = True
        assert (got == mask).all(), r.doc_id
        assert bytes(r.kept) == bytes(np.frombuffer(raw[r.doc_id], np.uint8)[~mask])


def passages():
    rnd = random.Random(4)
    base = prose(9, 900)
    texts = []
    for i in range(40):
        a, b = rnd.randrange(4000), rnd.randrange(4000)
        texts.append(base[a : a + rnd.randint(100, 700)] + prose(100 + i, rnd.randint(0, 60)) + base[b : b + rnd.randint(150, 260)])
    return [*texts, texts[0], texts[1] + "x", "a" * 700, "ab" * 300, "a" * 199, "é" * 150, "", None, base + base]


def test_spans_match_brute_force(spark):
    check(sd.deduplicated(table(spark, passages())), passages())


def test_crowded_grams_give_the_same(spark):
    check(sd.deduplicated(table(spark, passages()), crowd=2), passages())


def test_long_texts_cross_segments(spark, monkeypatch):
    texts = [prose(1, 1200), prose(1, 1200)[700:3000] + prose(2, 300), prose(3, 50)]
    raw = [t.encode() for t in texts]
    monkeypatch.setattr(sd, "SEGMENT", 1000)
    seen = [set() for _ in raw]
    for c, valid, which, place in sd._scans(raw):
        first, size, _, _, _ = sd.anchors(c, valid)
        for f, n in zip(first, size, strict=True):
            assert bytes(c[f : f + n]) == raw[which[f]][place[f] : place[f] + n]
            seen[which[f]] |= set(range(place[f], place[f] + n - 199))
    assert [len(s) for s in seen] == [max(0, len(t) - 199) for t in raw]  # every window has an anchor


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_orders_and_measures(seed):
    rnd = random.Random(seed)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    strings += [rnd.choice(strings) + b"ab" * rnd.randint(0, 3) for _ in range(40)]
    groups = np.array([rnd.randint(0, 3) for _ in strings])
    order, common = sd.suffix_array(strings, groups)
    key = [(groups[i], strings[i]) for i in range(len(strings))]
    assert [key[i] for i in order] == sorted(key)
    for k, i in enumerate(order):
        fresh = k == 0 or groups[order[k - 1]] != groups[i]
        assert common[k] == (-1 if fresh else sd._common(strings[order[k - 1]], strings[i]))


def test_awkward_rows(spark):
    docs = awkward(spark, extra=True)
    df = sd.deduplicated(docs)
    assert df.columns.count("spans") == 1 and df.columns.count("kept") == 1
    rows = df.collect()
    assert len(rows) == docs.count()
    assert all(len(r.kept) == 0 for r in rows if r.doc_id in (12, 13))  # equal texts, one of them twice
    assert all(not r.spans and bytes(r.kept) == (r.text or "").encode() for r in rows if len(r.text or "") < 200)
    assert sd.deduplicated(docs.limit(0)).count() == 0


def test_query_digests_match_brute_force(spark):
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    raw, masks = brute([d.text for d in docs])
    want = {}
    for d, t, m in zip(docs, raw, masks, strict=True):
        runs = int((np.diff(np.append(0, m.astype(int))) == 1).sum())
        want[d.doc_id] = (len(t), int(m.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest())
    got = op2_suffix_dedup(spark, "/root/testdata/sf0.001")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.select("*", F.lit(1)).collect()} == want


def test_users_columns_keep_their_values_whatever_their_names(spark):
    docs = table(spark, passages())
    names = ["rid", "rid2", "raw", "maybe", "doc", "place", "gram", "times"]
    wider = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names}).withColumn("spans", F.lit(1))
    got = sd.deduplicated(wider)
    check(got, passages())
    assert got.columns == [*docs.columns, *names, "spans", "kept"]
    assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names)


def test_no_rows_give_no_rows(spark):
    got = sd.deduplicated(table(spark, passages()).where("doc_id < 0"))
    assert got.count() == 0 and {"spans", "kept"} <= set(got.columns)


def test_texts_whose_first_number_is_equal_stay_apart(spark):
    """Two texts share ``rid``; only ``rid2`` tells them apart."""
    texts = [prose(1, 80) + prose(2, 60), prose(3, 90) + prose(2, 60)]
    rows = [(1, 10 + i, t.encode()) for i, t in enumerate(texts)]
    got = {r.rid2: r.spans for r in sd.spans(spark.createDataFrame(rows, "rid long, rid2 long, raw binary")).collect()}
    _, masks = brute(texts)
    assert set(got) == {10, 11}
    for i, mask in enumerate(masks):
        covered = np.zeros(len(mask), bool)
        for s in got[10 + i]:
            covered[s.lo : s.hi] = True
        assert (covered == mask).all()
