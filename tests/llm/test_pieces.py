"""Piece encoding against the library, on whole texts."""

import random

import numpy as np
import sentencepiece

from llm_docs import AWKWARD, awkward, prose, table
from whence.llm import sentencepieces
from whence.llm.queries import op3_sentencepiece, piece_model

ODD = ["  two  spaces  ", "▁mark ▁▁ inside▁", " lead", "trail ", "tab\tand\r\nlines\n", "<s> </s> <unk> <0x0A>", "a  b   c    d" + " " * 40, "é  nbsp em", "\u0000 nul"]


def check(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    df = sentencepieces.decode(sentencepieces.encode(table(spark, texts), piece_model()), piece_model())
    assert sorted(sentencepieces.round_trip(table(spark, texts), piece_model()).collect()) == sorted(df.collect())
    for r in df.collect():
        want = library.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.ids == want, repr(texts[r.doc_id])
        assert r.decoded == library.decode(want)


def test_ids_and_texts_equal_the_librarys(spark):
    rnd = random.Random(3)
    alphabet = " ▁\n\tabé中\U0001f600.,"
    check(spark, [*AWKWARD, *ODD, *("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(200)), prose(5, 500)])


def test_chunk_table_is_renewed(spark, monkeypatch):
    monkeypatch.setattr(sentencepieces, "CHUNKS", 5)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    known = sentencepieces.Chunks(library)
    known.add(["▁a", "▁", "▁bc"])
    ids, lengths = known.joined(np.array([2, 0, 1, 2]))
    want = [library.encode("bc"), library.encode("a"), [library.piece_to_id("▁")], library.encode("bc")]
    assert ids.tolist() == sum(want, []) and lengths.tolist() == list(map(len, want))


def test_awkward_rows_and_clashing_columns(spark):
    docs = awkward(spark, extra=True)
    df = sentencepieces.encode(docs, piece_model())
    assert df.columns.count("ids") == 1 and df.count() == docs.count()
    assert all(r.ids == [2] for r in df.where("text is null or text = ''").collect())
    assert sentencepieces.encode(docs.limit(0), piece_model()).count() == 0


def test_any_ids_decode_as_the_library_does():
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    known = sentencepieces.Bytes(library)
    rnd = random.Random(6)
    cases = [[], [0], [1], [2], [1, 5, 400], [2, 29871, 29871], [29871, 2], [0, 300], [300, 0, 301], [200, 201, 35], [35, 35]]
    cases += [[rnd.choice([rnd.randrange(3, 259), rnd.randrange(32000)]) for _ in range(rnd.randint(1, 12))] for _ in range(2000)]
    for ids in cases:
        assert known.text(np.array(ids, np.int32)) == library.decode(ids), ids


def test_query_over_the_whole_table(spark):
    assert op3_sentencepiece(spark, "/root/testdata/sf0.001").count() == 200


def test_round_trip_takes_awkward_rows(spark):
    docs = awkward(spark, extra=True)
    once, twice = sentencepieces.round_trip(docs, piece_model()), sentencepieces.decode(sentencepieces.encode(docs, piece_model()), piece_model())
    assert once.columns == twice.columns and once.schema.simpleString() == twice.schema.simpleString()
    assert once.exceptAll(twice).count() == twice.exceptAll(once).count() == 0
    assert sentencepieces.round_trip(docs.limit(0), piece_model()).count() == 0
