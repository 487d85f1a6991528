"""Helpers of the text operators: tables, folds, Arrow batches, word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from whence.session import tune

#: Records and bytes of a batch handed to Python; texts of any length pass, one batch holds one row at least.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return tune(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that would clash with new ones; names differ by more than case."""
    new = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in new])


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def added(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of a frame with one more column."""
    return StructType([*df.schema.fields, StructField(name, StructType.fromDDL(f"x {kind}")[0].dataType)])


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal id, modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    """A batch from arrays or lists, one for each field."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


class WordHashes(dict):
    """64-bit hashes of words, each word hashed once; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists laid end to end: the list of each element, and its place in it."""
    ends = np.cumsum(lengths)
    which = np.repeat(np.arange(len(lengths)), lengths)
    return which, np.arange(len(which)) - np.repeat(ends - lengths, lengths)


#: Name of the column that ``spread`` adds.
SPREAD = "_spread"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """One more join key, the hash of the keys.

    A side that was grouped by the keys is partitioned by them already; with this key the join
    shuffles both sides on exchanges of its own, and AQE can split a hot key of the other side.
    """
    return df.withColumn(SPREAD, F.xxhash64(*keys))


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows; at their end the worker gives freed memory back."""
    yield from (b for b in it if b.num_rows)
    trim()


def trim() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and idle ones would keep it."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


#: Bits of a sieve; its size is the same for any number of ids.
SIEVE_BITS = 23


def sieve(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of hashed ids of fixed size (1 MB), made in the cluster word by word."""
    at = F.pmod(F.xxhash64(column), F.lit(1 << SIEVE_BITS))
    words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 5).cast("int").alias("word"))
    bits = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits"))
    out = np.zeros(1 << (SIEVE_BITS - 5), np.uint32)
    found = bits.toArrow()  # 3 MB at most; a local iterator would run a job for each partition
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def sieved(column: str, bitmap: np.ndarray) -> Column:
    """False only for ids that were not in the sieve; a join after it decides. It spares a shuffle of the rest."""

    @F.pandas_udf("boolean")
    def holds(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((bitmap[at >> 5] >> (at & 31).astype(np.uint32)) & 1 > 0)

    return holds(F.pmod(F.xxhash64(column), F.lit(1 << SIEVE_BITS)))
