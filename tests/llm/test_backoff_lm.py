"""Backoff scores against counting in Python."""

import math
from collections import Counter

import numpy as np
import pytest

from llm_docs import AWKWARD, awkward, prose, table
from whence.llm import backoff_lm as lm
from whence.llm.queries import op8_backoff_lm


def brute(texts, order, backoff=lm.BACKOFF):
    docs = [(t or "").encode().split() for t in texts]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = {n: sum((grams(w, n) for w in docs), Counter()) for n in range(1, order + 1)}
    size, out = sum(map(len, docs)), []
    for w in docs:
        own = {n: grams(w, n) for n in range(1, order + 1)}
        count = lambda g: total[len(g)][g] - own[len(g)][g]  # noqa: B023, E731
        s = 0.0
        for i in range(len(w)):
            factor, score = 1.0, None
            for n in range(min(order, i + 1), 1, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if count(g) > 0:
                    score = count(g) / count(g[:-1])
                    break
                factor *= backoff
            if score is None:
                score = max(count((w[i],)), 0.5) / (size - len(w) + 1)
            s += math.log(factor * score)
        out.append((len(w), s))
    return out


TEXTS = [*AWKWARD[:7], *AWKWARD[8:], prose(1, 200), prose(1, 150) + " " + prose(2, 50), prose(3, 5), "a b a b a c", "a b a b"]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("block", [10, 400_000])
def test_scores_match_counting(spark, monkeypatch, order, block):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "PART", 300)
    rows = lm.scored(table(spark, TEXTS), order).orderBy("doc_id").collect()
    for r, (n, s) in zip(rows, brute(TEXTS, order), strict=True):
        assert r.n_words == n and r.log_score == pytest.approx(s, abs=1e-9)


def test_packing_round_trips():
    x = np.unique(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64))
    assert (lm.sorted_unpacked(lm.sorted_packed(x)) == x).all()
    assert len(lm.unpacked(lm.packed(x[:0]), np.uint64)) == 0
    assert (lm.unpacked(lm.packed(np.arange(7, dtype=np.uint32)), np.uint32) == np.arange(7)).all()


def test_awkward_rows(spark):
    docs = awkward(spark, extra=True)
    rows = lm.scored(docs).collect()
    assert len(rows) == docs.count() and all(r.log_score == 0 for r in rows if r.n_words == 0)
    assert lm.scored(docs.limit(0)).count() == 0


def test_query_scores_every_document(spark):
    assert op8_backoff_lm(spark, "/root/testdata/sf0.001").where("log_score < 0").count() == 200


def test_query_scores_trigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    rows = op8_backoff_lm(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    for r, (n, s) in zip(rows, brute([d.text for d in docs], 3), strict=True):
        assert r.n_words == n and r.log_score == pytest.approx(s, abs=1e-6)


def test_salad_of_common_bigrams_scores_below_prose(spark):
    # after b comes c where a was before, and d where x was: all bigrams of the salad are as common as those of the prose
    texts = ["a b c"] * 20 + ["x b d"] * 20 + ["a b d"]
    score = {r.doc_id: r.log_score for r in lm.scored(table(spark, texts)).collect()}
    assert score[40] < score[0] - 0.1
