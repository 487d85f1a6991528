"""Ranked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_docs import AWKWARD, awkward, prose, table
from whence.llm import lexical_search as ls
from whence.llm.queries import op13_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    tf = [Counter(words(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    n_docs, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c, size in zip(docs, tf, n):
            m = 75 + (25 * size * n_docs) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **kw):
    rows = ls.searched(docs, spark.createDataFrame(items, ITEMS), **kw).collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("shard", [3, 50_000])
@pytest.mark.parametrize("block", [1, 5_000])
def test_ranks_match_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ls, "SHARD_DOCS", shard)
    monkeypatch.setattr(ls, "BLOCK_ITEMS", block)
    rnd = random.Random(3)
    texts = [*AWKWARD, "Ä b-B b", "ties here", "ties here", *(prose(i % 30, rnd.randint(1, 60)) for i in range(60))]
    docs = list(enumerate(texts))
    items = [(1, prose(2, 12)), (2, "Ties ties TIES tie éè"), (3, None), (4, "b B nowhere"), (5, " ".join(prose(i, 3) for i in range(20))), (6, "word one")]
    assert found(spark, table(spark, texts), items) == brute(docs, items)
    assert found(spark, table(spark, texts), items, top=3) == brute(docs, items, 3)


def test_awkward_rows(spark):
    docs = awkward(spark, extra=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(1, "a word"), (None, prose(1, 3)), (1, "a word")]  # repeated items are ranked each
    assert found(spark, docs.withColumn("item_id", F.lit(1)).withColumn("rank", F.lit(1)), items) == brute(rows, items)
    assert found(spark, docs.limit(0), items) == [] and found(spark, docs, []) == []


def test_late_terms_open_no_accumulators():
    rnd = np.random.default_rng(1)
    n = 2000
    lists = {0: (np.arange(40), np.full(40, 900), 900), 1: (np.arange(n), rnd.integers(1, 10, n), 9)}
    scores = np.zeros(n, np.int64)
    live, got, opened = ls.evaluate([(0, 10), (1, 3)], lists, scores, 20, 0)
    assert opened == 40 and not scores.any()
    assert (got == 9000 + 3 * lists[1][1][:40]).all()
    assert ls.evaluate([(0, 10), (1, 3)], lists, scores, 60, 0)[2] == n  # too few documents have the rare term
    assert ls.evaluate([(1, 3)], lists, scores, 20, 28)[2] == 0  # earlier shards have better ones


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in op13_lexical_search(spark, sf).collect()), key=repr) == brute(docs, items)
