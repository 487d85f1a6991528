"""Give every row of a base table its provenance token."""

from __future__ import annotations

from dataclasses import replace

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.functions.monomials import PROV, as_column, key_text
from whence.operators.frame import Origin, ProvFrame


def _frame(df: DataFrame, token: Column, family: str, qualified: str | None) -> ProvFrame:
    if qualified is not None:
        token = F.concat(F.lit(f"{qualified}:"), token)
        family = f"{qualified}:{family}"
    return ProvFrame(df.withColumn(PROV, F.array(token)), origin=Origin.table(family))


def annotate_keys(df: DataFrame, prefix: str, keys: list[str], qualified: str | None = None) -> ProvFrame:
    """Token ``prefix + key``; compound keys are joined by ``_``, escaped inside strings.

    The key must be unique, and the prefixes of different tables must differ.  A NULL part
    prints as ``\\N``.
    """
    text = as_column(keys[0]).cast("string") if len(keys) == 1 else key_text(keys, dict(df.dtypes), "_")
    return _frame(df, F.concat(F.lit(prefix), text), prefix, qualified)


def annotate_ordinal(df: DataFrame, prefix: str, qualified: str | None = None) -> ProvFrame:
    """Token ``prefix + file + _ + row``: the number of the file and of the row in it.

    The row number is the Parquet reader's own row index: no shuffle, no sort, no window over a
    hot key, exact for rows that are copies of each other, and the same when a lost
    executor's task is run again.  The file's number is 60 bits of a hash of its name within
    the table, from the first folder with a ``=`` on, so tokens stay when a table is moved or grows.
    Only built-in functions that pass once over the path are used: it is the same in every row of a file.
    """
    path, at = F.col("_metadata.file_path"), F.instr("_metadata.file_path", "=")
    folder = F.substring_index(F.substring(path, F.lit(1), at - 1), "/", -1)
    inside = F.xxhash64(F.concat(folder, F.substring(path, at, F.length(path))))
    number = F.when(F.contains(path, F.lit("=")), inside).otherwise(F.xxhash64("_metadata.file_name"))
    file = F.shiftrightunsigned(number, 4).cast("string")
    row = (F.col("_metadata.row_index") + 1).cast("string")
    return _frame(df, F.concat(F.lit(prefix), file, F.lit("_"), row), prefix, qualified)


def file_number(name: str) -> int:
    """The number of a file in the tokens of ``annotate_ordinal``."""
    return xxhash.xxh64_intdigest(name.encode(), seed=42) >> 4


def read_annotated(
    df: DataFrame, column: str = PROV, qualified: str | None = None, family: str | None = None
) -> ProvFrame:
    """Take over a table whose string column already holds one token per row.

    Name a ``family`` if the tokens are known to be unique, and different from those of
    other families; this saves merging equal terms later.
    """
    token = F.col(column)
    if column != PROV:
        df = df.withColumnRenamed(column, PROV)
        token = F.col(PROV)
    frame = _frame(df, token, family or "", qualified)
    return frame if family else replace(frame, origin=Origin())
