"""Jaccard components against brute force."""

import random
import re

import numpy as np
import pytest

from llm_docs import awkward, prose, table
from whence.llm import ngram_join as nj
from whence.llm.queries import op10_ngram_join

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(texts):
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def edited(text, rnd, share):
    words = text.split()
    for _ in range(int(len(words) * share)):
        words[rnd.randrange(len(words))] = "w" + str(rnd.randrange(10**6))
    return " ".join(words)


def family(seed):
    """Copies, near copies, chains of near copies, and texts around a common passage."""
    rnd = random.Random(seed)
    texts = []
    for i in range(6):
        base = prose(seed * 100 + i, rnd.choice([3, 8, 12, 40, 200, 800]))
        texts += [base, base.upper(), *(edited(base, rnd, rnd.choice([0.005, 0.01, 0.02, 0.03])) for _ in range(8))]
        step = base
        for _ in range(6):
            step = edited(step, rnd, 0.02)
            texts.append(step)
    passage = prose(seed + 7, 30)
    texts += [passage + " " + prose(5000 + i, rnd.randint(1, 8)) for i in range(25)]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    texts = family(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.joined(table(spark, texts)).collect()}
    assert got == brute(dict(enumerate(texts)))


def test_blocks_of_a_crowded_key(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(1, 40, i, i, -1, 20, nj.count_vector(np.arange(20, dtype=np.uint64) + np.uint64(i // 4)).tobytes()) for i in range(40)],
        "key long, members long, id long, comp long, pivot long, n long, counts binary",
    )
    whole = {(r.a, r.b) for r in nj._searched(rows).collect()}
    monkeypatch.setattr(nj, "BLOCK", 7)
    assert {(r.a, r.b) for r in nj._searched(rows).collect()} == whole and len(whole) >= 60


def test_keys_and_tree_lose_no_link():
    rnd = random.Random(3)
    sets = []
    for _ in range(60):
        s = np.unique(np.array([rnd.getrandbits(64) for _ in range(rnd.randint(5, 400))], np.uint64))
        k = rnd.randint(0, len(s) // 8)
        sets += [s, np.unique(np.append(s[k:], np.array([rnd.getrandbits(64) for _ in range(rnd.randint(0, 3))], np.uint64)))]
    n, v = np.array([len(s) for s in sets]), np.array([nj.count_vector(s) for s in sets])
    keys = [set(nj.group_keys(s).tolist()) for s in sets]
    found = {(int(a), int(b)) for q, p in nj.CountTree(v, n).search(v, n) for a, b in zip(q, p, strict=True)}
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                assert (i, j) in found and (j, i) in found
                assert np.array_equal(sets[i], sets[j]) or keys[i] & keys[j]
    assert links > 20


def test_shared_rows_over_many_batches(spark):
    rnd = random.Random(8)
    rows = sorted({(rnd.randrange(30), rnd.randrange(40)) for _ in range(300)} | {(100, i) for i in range(50)} | {(200, 5)})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(tuple(r) for r in nj._shared(spark.createDataFrame(rows, "key long, id long")).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    by_key = {}
    for k, i in rows:
        by_key.setdefault(k, []).append(i)
    assert got == sorted((k, i, min(ids)) for k, ids in by_key.items() if len(ids) > 1 for i in ids)


def test_components_of_paths_stars_and_cliques(spark):
    links = [(i, i + 1) for i in range(30)] + [(50, i) for i in range(51, 70)] + [(80, 81), (81, 82), (80, 82), (90, 91)]
    got = {r.id: r.comp for r in nj.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 50 for i in range(50, 70)}, 80: 80, 81: 80, 82: 80, 90: 90, 91: 90}
    assert nj.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(spark):
    docs = awkward(spark, extra=True)
    rows = nj.joined(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id in (0, 1, 2, 3):
            assert (r.n_shingles, r.component_id) == (0, r.doc_id)
        if r.doc_id in (8, 9):
            assert (r.n_shingles, r.component_id) == (1, 8)
        if r.doc_id in (12, 13):
            assert r.component_id == 12
    assert nj.joined(docs.limit(0)).count() == 0
    kept = nj.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12] and ids.count(None) == 1


def test_query_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_ngram_join(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(docs)


def test_other_shingles_and_percent_match_brute_force(spark):
    texts = family(5)
    rnd = random.Random(6)
    for i in range(12):
        words = prose(700 + i, rnd.choice([4, 5, 6, 9, 30, 300])).split()
        for k in (0, 1, 2, 3):
            copy = list(words)
            for at in rnd.sample(range(len(words)), min(len(words), k * len(words) // 60 + (k > 1))):
                copy[at] = f"edit{i}{k}{at}"
            texts.append(" ".join(copy))
    sets = {}
    for i, t in enumerate(texts):
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a + 1, len(texts)):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.joined(table(spark, texts), words=5, percent=80).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("percent", [50, 70, 80, 90, 99])
def test_linked_sets_have_a_key_in_common(percent):
    rnd = np.random.default_rng(percent)
    for size in [*range(1, 130), 400, 401, 900]:
        for _ in range(3):
            s = rnd.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2)
            k = int(rnd.integers(0, nj._differ(size, percent) + 1))
            gone = min(size - 1, int(rnd.integers(0, k + 1)))
            other = np.append(s[gone:], rnd.integers(0, 2**63, k - gone).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            both = len(s) - gone
            if 100 * both >= percent * (len(s) + len(other) - both) and (gone or len(other) > len(s)):
                x, y = nj.group_keys(np.unique(s), percent), nj.group_keys(np.unique(other), percent)
                assert len(np.intersect1d(x, y)), (size, k, gone)


def test_count_vectors_decide_before_sets_are_compared(spark):
    tokens = np.arange(40, dtype=np.uint64)
    none = np.zeros(nj.GROUPS, np.uint16).tobytes()  # bounds every overlap by 0
    rows = [(i, 40, tokens.tobytes(), none if i == 3 else nj.count_vector(tokens).tobytes()) for i in (1, 2, 3)]
    sets = spark.createDataFrame(rows, "id long, n long, tokens binary, counts binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert [(r.a, r.b) for r in nj._verified(pairs, sets).collect()] == [(1, 2)]


def test_components_stop_at_stars(spark, monkeypatch):
    tables, stored = [], nj.stored
    monkeypatch.setattr(nj, "stored", lambda df, name: tables.append(name) or stored(df, name))
    got = nj.components(spark.createDataFrame([(1, 5), (7, 1), (2, 3)], "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(1, 1), (5, 1), (7, 1), (2, 2), (3, 2)} and len(tables) == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merged_components_are_those_of_all_links(spark, seed):
    rnd = random.Random(seed)
    first, second = ([(rnd.randrange(60), rnd.randrange(60)) for _ in range(n)] for n in (20, 25))
    of = lambda links: spark.createDataFrame(links, "a long, b long")
    want = sorted(map(tuple, nj.components(of(first + second)).collect()))
    assert sorted(map(tuple, nj.merged(nj.components(of(first)), of(second)).collect())) == want
    assert sorted(map(tuple, nj.merged(nj.components(of(first)), of([])).collect())) == sorted(map(tuple, nj.components(of(first)).collect()))


def test_sieve_runs_few_jobs(spark):
    from whence.llm.common import SIEVE_BITS, sieve

    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("sieve", "sieve")
    try:
        ids = spark.range(3000)
        bits = sieve(ids, "id")
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("sieve")) < 8
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    at = np.array([r.h for r in ids.selectExpr(f"pmod(xxhash64(id), {1 << SIEVE_BITS}) h").collect()])
    assert np.all((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1) and sum(int(x).bit_count() for x in bits) == len(set(at))
