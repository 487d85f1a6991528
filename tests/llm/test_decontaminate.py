"""Leaks with edits against edit distance by dynamic programming."""

import random

import numpy as np
import pytest

from llm_docs import awkward, prose, table
from whence.llm import decontaminate as dc
from whence.llm.queries import op5_decontamination

ITEMS = "item_id long, text string"


def least_edits(item, text):
    """Fewest edits between the item and any stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        moved = np.append(i, row[:-1] + (text != c))
        moved = np.minimum(moved, row + 1)
        row = np.minimum.accumulate(moved - np.arange(len(row))) + np.arange(len(row))
    return int(row.min())


def edited(text, k, rnd):
    text = list(text)
    for _ in range(k):
        at = rnd.randrange(len(text))
        what = rnd.randrange(3)
        text[at : at + (what != 1)] = [] if what == 0 else [rnd.choice("abcdef ")]
    return "".join(text)


def test_leaks_match_edit_distance(spark):
    rnd = random.Random(2)
    items = [prose(900 + i, rnd.randint(5, 60)) for i in range(12)] + ["Short one here, ok?!", "tiny", "", None]
    texts = []
    for i in range(60):
        item = items[i % 13]
        part = edited(item, rnd.randint(0, len(item) // 7), rnd)
        texts.append(prose(i, rnd.randint(0, 40)) + " " + (part.upper() if i % 2 else part.replace(" ", "\n")) + " " + prose(300 + i, rnd.randint(0, 40)))
    bench = spark.createDataFrame(list(enumerate(items)), ITEMS)
    for r in dc.leaks(table(spark, texts), bench).collect():
        text = dc.codes(r.text)
        want = {}
        for i, item in enumerate(items):
            c = dc.codes(item or "")
            if len(c) >= dc.LEAST and (d := least_edits(c, text)) <= int(len(c) * dc.EDITS):
                want[i] = d
        got = {}
        for x in r.leaks:
            got[x.item_id] = min(x.edits, got.get(x.item_id, 99))
            assert least_edits(dc.codes(items[x.item_id]), text[x.start : x.end]) <= x.edits
        assert got == want, r.doc_id


def test_an_item_that_occurs_twice_is_found_twice(spark):
    item = prose(1, 30)
    bench = spark.createDataFrame([(7, item), (3, item.upper())], ITEMS)
    (r,) = dc.leaks(table(spark, [f"{item} and then {item}"]), bench).collect()
    assert [(x.item_id, x.start, x.edits) for x in r.leaks] == [(3, 0, 0), (3, len(item) + 10, 0)]


def test_blocks_of_the_benchmark_find_the_same(spark, monkeypatch):
    items = [(i, prose(i, 25)) for i in range(9)]
    docs = table(spark, [items[i % 9][1] + " " + prose(50 + i, 20) for i in range(18)])
    bench = spark.createDataFrame(items, ITEMS)
    found = lambda: {r.doc_id: [x.item_id for x in r.leaks] for r in dc.leaks(docs, bench).collect()}
    whole = found()
    assert all(whole[i] == [i % 9] for i in range(18))
    monkeypatch.setattr(dc, "BLOCK", 300)
    assert found() == whole


@pytest.mark.parametrize("seed", range(3))
def test_alignment_is_the_edit_distance(seed):
    rnd = random.Random(seed)
    item = dc.codes(prose(seed, 20))
    text = dc.codes(prose(9, 5) + edited(prose(seed, 20), 6, rnd) + prose(8, 5))
    edits, end = dc.aligned(item, text, -len(item), len(text))
    assert edits == least_edits(item, text) and 0 <= end <= len(text)


def test_awkward_rows(spark):
    docs, bench = awkward(spark, extra=True), spark.createDataFrame([(1, prose(1, 400)), (None, "x" * 50), (2, None)], ITEMS)
    df = dc.leaks(docs, bench)
    assert df.columns.count("leaks") == 1
    rows = df.collect()
    assert len(rows) == docs.count() and all(bool(r.leaks) == (r.doc_id in (12, 13)) for r in rows)
    assert dc.clean(docs, bench).count() == docs.count() - 3 and dc.clean(docs, bench).columns == docs.columns
    assert dc.leaks(docs, bench.limit(0)).count() == docs.count() and dc.leaks(docs.limit(0), bench).count() == 0


def test_query_finds_every_contained_item(spark):
    sf_dir = "/root/testdata/sf0.01"
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if any(i in r.text for i in items)}
    got = {r.doc_id: r.contaminated for r in op5_decontamination(spark, sf_dir).collect()}
    assert want <= {k for k, v in got.items() if v} and len(got) == 1000


def test_short_items_are_found_between_word_boundaries(spark):
    items = [(1, "Blue whale"), (2, " 42? "), (3, "a"), (4, "?!"), (5, "中文"), (6, "blue  whale"), (7, prose(1, 30)), (8, "")]
    texts = ["the BLUE\nwhale, 42? no", "bluewhale blue whales 142? 42", "is a", "x 我中文字 ?!", "", None, "blue whale blue whale", prose(1, 30) + " 42?"]
    docs, bench = table(spark, texts), spark.createDataFrame(items, ITEMS)
    got = {r.doc_id: sorted((x.item_id, x.start, x.end, x.edits) for x in r.leaks) for r in dc.leaks(docs, bench).collect()}
    n = len(prose(1, 30))
    assert got == {
        0: [(1, 4, 14, 0), (2, 16, 19, 0)], 1: [], 2: [(3, 3, 4, 0)], 3: [(5, 3, 5, 0)], 4: [], 5: [],
        6: [(1, 0, 10, 0), (1, 11, 21, 0)], 7: [(2, n + 1, n + 4, 0), (7, 0, n, 0)],
    }
    assert {r.doc_id for r in dc.clean(docs, bench).collect()} == {1, 4, 5}
