"""The pipeline's stages one by one on their own input."""

import sentencepiece

import corpus_pipeline as cp
from llm_docs import awkward, prose, table
from whence.llm.queries import QUERIES, op6_toxicity, piece_model

SF_DIR = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, n = docs.columns, docs.count()
    seen = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, seen, SF_DIR)
        assert out.columns == columns and out.dtypes == docs.dtypes, name
        assert out.count() <= seen.count()
        seen = out
    last = cp.run(spark, SF_DIR)
    assert set(columns) < set(last.columns)
    rows = last.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in seen.collect()} and 0.5 * n < len(rows) < n
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    assert all(r.decoded == r.text and r.ids == library.encode(r.text, add_eos=True) and r.n_chars == len(r.text) for r in rows)


def test_toxic_documents_go(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    bad = {r.doc_id for r in op6_toxicity(spark, SF_DIR).where("predicted = 1").collect()}
    assert {r.doc_id for r in cp.drop_toxic(spark, docs, SF_DIR).collect()} == {r.doc_id for r in docs.collect()} - bad


def test_stages_take_awkward_rows(spark):
    docs = awkward(spark, extra=True)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, SF_DIR)
        out.collect()
        assert stage is cp.encode or out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_near_copies_by_five_words_go(spark):
    words = prose(1, 500).split()
    edits = list(words)
    for at in range(20, 500, 50):  # ten separate edits: 5-word Jaccard 0.82, 3-word Jaccard 0.886
        edits[at] = f"edit{at}"
    docs = table(spark, [" ".join(words), " ".join(edits), prose(2, 500)])
    assert sorted(r.doc_id for r in cp.drop_copies(spark, docs, SF_DIR).collect()) == [0, 2]


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in QUERIES if n.startswith("op")}
    assert set(QUERIES) | {"pipeline"} <= set(names)
