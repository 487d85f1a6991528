"""Small document tables with the awkward rows every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [None, "", " ", "\n\n", "a", "one two", "x" * 3000, "word " * 3000, "tie", "tie", "éè 中文 \U0001f600", "\x00\x01 �"]


def prose(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    stems = "ba ce di fo gu ha je ki lo mu na pe ri so tu".split()
    return " ".join("".join(rnd.choice(stems) for _ in range(rnd.randint(1, 4))) for _ in range(words))


def table(spark, texts, extra: bool = False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # columns that operators use for their own results

        for name in ("ids", "score", "leaks", "spans", "kept", "pii", "keys", "rows", "y"):
            df = df.withColumn(name, F.lit("mine"))
    return df


def awkward(spark, extra: bool = False):
    """The awkward texts, a repeated row, a null id."""
    df = table(spark, [*AWKWARD, prose(1, 400), prose(1, 400)], extra)
    return df.union(df.where("doc_id = 12")).union(df.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
