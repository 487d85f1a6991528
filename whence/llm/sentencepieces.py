"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model has a white space marker after another character, so merges never cross
the start of a marked word: each distinct marked word is segmented once, and the ids are joined
back by position.  ``encode`` checks that property of the model and refuses others.

The table lives in the task, grows over its batches and is emptied at ``CHUNKS`` entries.
Null texts count as empty; empty texts have the end id alone and decode to the empty text.
An existing column with the name of the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from whence.llm.common import added, batches, ragged, texts, without

MARK = "▁"
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Entries a task's table may hold.
CHUNKS = 150_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def _processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def chunkable(model: str) -> bool:
    """Whether no piece crosses the start of a marked word, and texts are taken as they are."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(model, "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    rules = proto.normalizer_spec
    plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
    return plain and not any(re.search(f"[^{MARK}]{MARK}", p.piece) or p.type == p.USER_DEFINED for p in proto.pieces)


class Chunks(dict):
    """Chunk -> row of the table; a row's ids lie in ``ids`` from ``starts`` on."""

    def __init__(self, processor):
        super().__init__()
        self.processor, self.lone = processor, processor.piece_to_id(MARK)
        self.ids, self.lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

    def add(self, chunks: list[str]) -> None:
        got = self.processor.encode([c[1:] for c in chunks], num_threads=1)  # the library puts the marker back
        got = [ids if len(c) > 1 else [self.lone] for c, ids in zip(chunks, got, strict=True)]
        self.update(zip(chunks, range(len(self), len(self) + len(chunks)), strict=True))
        self.ids.append(np.fromiter(chain.from_iterable(got), np.int32))
        self.lengths.append(np.fromiter(map(len, got), np.int64, len(got)))

    def joined(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows end to end, and each row's number of ids."""
        self.ids, self.lengths = [np.concatenate(self.ids)], [np.concatenate(self.lengths)]
        starts, lengths = np.cumsum(self.lengths[0]) - self.lengths[0], self.lengths[0][rows]
        which, place = ragged(lengths)
        return self.ids[0][starts[rows][which] + place], lengths


def _encoding(model: str, text: str, out: str) -> Step:
    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _processor(model)
        end, known = processor.eos_id(), Chunks(processor)
        for b in batches(it):
            if len(known) > CHUNKS:
                known = Chunks(processor)
            split = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts(b, text)]
            if new := [c for c in dict.fromkeys(chain.from_iterable(split)) if c not in known]:
                known.add(new)
            counts = np.fromiter(map(len, split), np.int64, len(split))
            flat, lengths = known.joined(np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, counts.sum()))
            sums = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
            flat = np.insert(flat, sums[1:], end)
            ids = pa.ListArray.from_arrays(pa.array(sums + np.arange(len(sums)), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, out])

    return part


def _checked(model: str) -> str:
    if not chunkable(model):
        raise ValueError("pieces of this model can cross white space markers")
    return model


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the ids of the text with the end id, as the library encodes the whole text."""
    docs = without(docs, out)
    return docs.mapInArrow(_encoding(_checked(model), text, out), added(docs, out, "array<int>"))


class Bytes:
    """The bytes of each piece; a list of ids is their concatenation where that is valid UTF-8."""

    def __init__(self, processor):
        self.processor = processor
        pieces = [processor.id_to_piece(i) for i in range(processor.vocab_size())]
        self.table = np.array([self._of(i, p) for i, p in enumerate(pieces)], object)
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        #: Left to the library: unknown pieces anywhere, control pieces at the start.
        self.odd = np.array([processor.is_unknown(i) for i in range(len(pieces))])
        self.control = np.array([processor.is_control(i) for i in range(len(pieces))])

    def _of(self, i: int, piece: str) -> bytes:
        if self.processor.is_control(i):
            return b""
        return bytes([int(piece[3:5], 16)]) if self.processor.is_byte(i) else piece.replace(MARK, " ").encode()

    def text(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        if not self.odd[ids].any() and not (self.control[ids[0]] and len(ids) > 1):
            try:
                text = b"".join(self.table[ids].tolist()).decode()
                return text[1:] if self.marked[ids[0]] else text
            except UnicodeDecodeError:
                pass
        return self.processor.decode(ids.tolist())


def _decoding(model: str, ids: str, out: str) -> Step:
    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bytes(_processor(model))
        for b in batches(it):
            lists = b.column(ids)
            flat, at, present = lists.values.to_numpy(), lists.offsets.to_numpy(), lists.is_valid().to_pylist()
            got = [known.text(flat[lo:hi]) if here else None for lo, hi, here in zip(at[:-1], at[1:], present, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, out])

    return part


def decode(rows: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and the text of the ids, as the library decodes them; null for null."""
    rows = without(rows, out)
    return rows.mapInArrow(_decoding(model, ids, out), added(rows, out, "string"))


def round_trip(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one worker for each task instead of two."""
    docs = without(docs, ids, out)
    encoding, decoding = _encoding(_checked(model), text, ids), _decoding(model, ids, out)
    schema = StructType([*added(docs, ids, "array<int>").fields, StructField(out, StringType())])
    return docs.mapInArrow(lambda it: decoding(encoding(it)), schema)
