"""Quality classifier, toxicity, quality rules: learning, held-out accuracy, awkward rows."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_docs import AWKWARD, awkward, prose, table
from whence.llm import quality, quality_rules, toxicity
from whence.llm.common import fold

SF_DIR = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")


def test_fold_is_crc32_of_the_decimal_id(spark):
    rows = spark.range(50).select("id", fold(F.col("id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_quality_held_out_accuracy(corpus):
    docs, labels = corpus
    w = quality.fit(docs, labels, "quality", learn=fold(F.col("doc_id"), 4) != 2)
    held = quality.score(docs, w).join(labels, "doc_id").where(fold(F.col("doc_id"), 4) == 2).collect()
    right = sum((r.score >= 0.7) == bool(r.quality) for r in held)
    assert right / len(held) > 0.9


def toxic_docs(spark):
    texts = [prose(i, 60) + (". You vile fool. " if i % 4 == 0 else ". ") + prose(1000 + i, 40) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], LABELS)
    return table(spark, texts), labels


def test_toxicity_learns_from_document_labels_and_finds_the_sentence(spark):
    docs, labels = toxic_docs(spark)
    w = toxicity.fit(docs, labels, "toxic", learn=F.lit(True))
    held = toxicity.score(docs, w).where("doc_id >= 300").collect()
    assert np.mean([(r.score >= 0.7) == (r.doc_id % 4 == 0) for r in held]) > 0.95
    found = [s.text for r in held if r.doc_id % 4 == 0 for s in r.offending]
    assert found and np.mean(["vile" in s for s in found]) > 0.9
    clean = {r.doc_id for r in toxicity.clean(docs, w, 0.7).collect()}
    assert clean == {r.doc_id for r in toxicity.score(docs, w).where("score < 0.7").collect()}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_models_take_awkward_rows_and_no_labels(spark, module):
    docs = awkward(spark, extra=True)
    none = spark.createDataFrame([], LABELS)
    w = module.fit(docs, none, "quality", learn=F.lit(True))
    rows = module.score(docs, w).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    some = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (12, 1, 1), (3, None, None), (None, 1, 1)], LABELS)
    w = module.fit(docs, some, "quality", learn=F.lit(True))
    by_id = {}
    for r in module.score(docs, w).collect():
        assert by_id.setdefault(r.doc_id, r.score) == r.score  # repeated rows alike
    assert by_id[0] == by_id[1]  # null as empty
    assert module.score(docs.limit(0), w).count() == 0


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if x.strip("\t\n\x0b\x0c\r ")]
    fives = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, f in enumerate(fives) if fives.count(f) > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def test_base_counts_match_brute_force(spark):
    texts = [*AWKWARD[:7], *AWKWARD[8:], "a b c d e f a b c d e", "a\na\n\nb\n b\na", "x# $y %% <b>", "a b c\x0bd"]
    rows = quality_rules.judged(table(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        assert tuple(r[1:6]) == counts(t), t
        n, again = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 10 or 100 * again > 20 * n)
        assert not (r.kept and r.base_failed)


def test_rules_keep_prose_and_reject_junk(spark):
    good = [prose(i, 80) for i in range(200)]
    junk = [" ".join(w + "###" for w in prose(i, 60).split()) for i in range(20)] + [prose(i, 60).upper().replace(" ", "** ") for i in range(20)]
    rows = quality_rules.judged(table(spark, good + junk)).collect()
    assert all(r.kept == (r.doc_id < 200) for r in rows)


def test_rules_take_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark, extra=True)
    assert quality_rules.judged(docs).count() == docs.count()
    assert quality_rules.judged(docs.limit(0)).count() == 0


def test_estimate_separates_the_two_kinds():
    k = len(quality_rules.RULES)
    patterns = {"+" * k: 900, "-" + "+" * (k - 1): 60, "--" + "+" * (k - 2): 40}
    post = quality_rules.estimate(patterns)[3]
    assert post["+" * k] > 0.9 and post["--" + "+" * (k - 2)] < 0.1


def test_long_clean_text_stays_with_and_without_labels(spark):
    docs, labels = toxic_docs(spark)
    long = table(spark, [" ".join(f"{prose(i, 6)}." for i in range(2000))])
    for known in (labels, labels.limit(0)):
        w = toxicity.fit(docs, known, "toxic", learn=F.lit(True))
        (r,) = toxicity.score(long, w).collect()
        assert r.score < 0.7 and toxicity.clean(long, w, 0.7).count() == 1


def test_shape_is_of_the_whole_word():
    shapes = quality.Shapes()
    assert shapes["ab1" * 30] != shapes["ab1" * 30 + "X-7"] and shapes["a" * 64 + "1"] != shapes["a" * 64]


@pytest.mark.parametrize("lang", ["en", "fr", "de", "es"])
def test_toxicity_held_out_by_language(spark, lang, toxic_scores):
    held = [r for r in toxic_scores if r.lang == lang]
    caught = np.mean([r.score >= 0.7 for r in held if r.toxic])
    kept = np.mean([r.score < 0.7 for r in held if not r.toxic])
    assert caught > (0.85 if lang == "en" else 0.6) and kept > 0.98  # a tenth of the labels is wrong, and 12 to 30 are toxic


def test_toxicity_held_out_overall(toxic_scores):
    assert np.mean([r.score >= 0.7 for r in toxic_scores if r.toxic]) > 0.8


@pytest.fixture(scope="module")
def toxic_scores(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    w = toxicity.fit(docs, labels, "toxic", learn=fold(F.col("doc_id"), 3) != 1)
    return toxicity.score(docs, w).join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id").where(fold(F.col("doc_id"), 3) == 1).collect()


def test_equal_stems_share_weight_and_scores_are_finite(spark):
    texts = [prose(i, 40) + (f". You vilest{'abcdefgh'[i % 8]}{i}ing one. " if i % 4 == 0 else ". ") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], LABELS)
    docs = table(spark, texts + [" ".join(f"You vilest{i}. " for i in range(500))])
    w = toxicity.fit(docs, labels, "toxic", learn=F.lit(True))
    with np.errstate(all="raise"):
        held = toxicity.score(docs, w).where("doc_id >= 300").collect()
    assert np.mean([(r.score >= 0.7) == (r.doc_id % 4 == 0) for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in held)
