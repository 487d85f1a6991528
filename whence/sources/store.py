"""Provenance store: derivations as a long Parquet table instead of text in a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whence.functions import monomials as mono
from whence.operators.semirings import Polynomials


def store_table(poly: Polynomials) -> DataFrame:
    """``(out, derivation, coef, token, exp)``, one row per token of a derivation."""
    flat = poly.terms.select(
        "out",
        F.md5(F.concat_ws("~", "out", mono.monomial_text("m"))).alias("derivation"),
        F.col("c").alias("coef"),
        "m",
    )
    exponent = F.size(F.filter("m", lambda t: t == F.col("token"))).cast("long")
    tokens = flat.withColumn("token", F.explode(F.array_distinct("m")))
    return tokens.select("out", "derivation", "coef", "token", exponent.alias("exp"))


def write_store(poly: Polynomials, path: str, mode: str = "error") -> None:
    store_table(poly).write.mode(mode).parquet(path)


def read_store(spark: SparkSession, path: str, delta: bool = False) -> Polynomials:
    """Polynomials back from the store."""
    powers = F.flatten(F.transform(F.collect_list(F.struct("token", "exp")), _repeat))
    terms = (
        spark.read.parquet(path)
        .groupBy("out", "derivation")
        .agg(F.first("coef").alias("c"), F.sort_array(powers).alias("m"))
        .select("out", "m", "c")
    )
    return Polynomials(terms, delta)


def _repeat(x):
    return F.array_repeat(x["token"], x["exp"].cast("int"))
