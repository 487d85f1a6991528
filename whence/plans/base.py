"""Annotated base tables, the query registry, and helpers to write the matching SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whence.operators.frame import ProvFrame
from whence.session import tune
from whence.sources.tokens import annotate_keys, annotate_ordinal, file_number


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(lambda spark, sf_dir: fn(Tables(tune(spark), sf_dir)), sql)
        return fn

    return add


class Tables:
    """The given tables, read lazily and annotated."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def region(self) -> ProvFrame:
        return annotate_keys(self.read("region"), "R", ["r_regionkey"])

    @cached_property
    def nation(self) -> ProvFrame:
        return annotate_keys(self.read("nation"), "N", ["n_nationkey"])

    @cached_property
    def customer(self) -> ProvFrame:
        return annotate_keys(self.read("customer"), "C", ["c_custkey"])

    @cached_property
    def supplier(self) -> ProvFrame:
        return annotate_keys(self.read("supplier"), "S", ["s_suppkey"])

    @cached_property
    def part(self) -> ProvFrame:
        return annotate_keys(self.read("part"), "P", ["p_partkey"])

    @cached_property
    def orders(self) -> ProvFrame:
        return annotate_keys(self.read("orders"), "O", ["o_orderkey"])

    @cached_property
    def lineitem(self) -> ProvFrame:
        return annotate_ordinal(self.read("lineitem"), "L")

    @cached_property
    def events(self) -> ProvFrame:
        return annotate_keys(self.read("events"), "E", ["event_id"])

    @cached_property
    def points(self) -> ProvFrame:
        df = self.read("embeddings").select(
            "vec_id",
            "label",
            F.get("embedding", F.lit(0)).cast("double").cast("decimal(9,6)").alias("x"),
            F.get("embedding", F.lit(1)).cast("double").cast("decimal(9,6)").alias("y"),
        )
        return annotate_keys(df, "V", ["vec_id"])

    @cached_property
    def partsupp(self) -> ProvFrame:
        """One row per (part, supplier) that occurs in lineitem."""
        df = (
            self.read("lineitem")
            .groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"))
            .agg(
                F.sum(money("l_quantity")).cast("decimal(18,2)").alias("ps_availqty"),
                F.min(money("l_extendedprice")).alias("ps_supplycost"),
            )
        )
        return annotate_keys(df, "PS", ["ps_partkey", "ps_suppkey"])


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(12,2)")


def volume() -> Column:
    """``l_extendedprice * (1 - l_discount)`` as an exact decimal."""
    return money("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))


def result(frame: ProvFrame) -> DataFrame:
    """Result columns and ``how``; decimals as double, timestamps as date."""
    df = frame.how()
    for c, t in df.dtypes:
        if t.startswith("decimal"):
            df = df.withColumn(c, F.col(c).cast("double"))
        elif t.startswith("timestamp"):
            df = df.withColumn(c, F.col(c).cast("date"))
    return df


# ---- SQL side --------------------------------------------------------------

PRELUDE = """WITH
r AS (SELECT *, 'R' || r_regionkey AS rt FROM region),
n AS (SELECT *, 'N' || n_nationkey AS nt FROM nation),
c AS (SELECT *, 'C' || c_custkey AS ct FROM customer),
s AS (SELECT *, 'S' || s_suppkey AS st FROM supplier),
p AS (SELECT *, 'P' || p_partkey AS pt FROM part),
o AS (SELECT *, 'O' || o_orderkey AS ot FROM orders),
l AS (SELECT *, 'L%d_' || row_number() OVER () AS lt FROM lineitem),
e AS (SELECT *, 'E' || event_id AS et FROM events),
v AS (SELECT vec_id, label, CAST(CAST(embedding[1] AS DOUBLE) AS DECIMAL(9,6)) AS x,
             CAST(CAST(embedding[2] AS DOUBLE) AS DECIMAL(9,6)) AS y, 'V' || vec_id AS vt FROM embeddings),
ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey,
              sum(CAST(l_quantity AS DECIMAL(12,2))) AS ps_availqty,
              min(CAST(l_extendedprice AS DECIMAL(12,2))) AS ps_supplycost,
              'PS' || l_partkey || '_' || l_suppkey AS pst FROM lineitem GROUP BY l_partkey, l_suppkey)""" % file_number("lineitem.parquet")

VOLUME = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"


def dec(c: str) -> str:
    return f"CAST({c} AS DECIMAL(12,2))"


def mean(c: str) -> str:
    return f"(CAST(sum({dec(c)}) AS DOUBLE) / count({c}))"


def prod(*tokens: str) -> str:
    """Monomial text of a product of tokens."""
    return f"array_to_string(list_sort([{', '.join(tokens)}]), ' . ')"


def gate(name: str, *keys: str) -> str:
    if not keys:
        return f"'{name}[]'"
    return f"'{name}[' || " + " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) + " || ']'"


def with_(*ctes: str, body: str) -> str:
    return ",\n".join([PRELUDE, *ctes]) + "\n" + body


def circuit_sql(*gates: tuple[str, str, str], ctes: tuple[str, ...] = ()) -> str:
    """SQL of a circuit from (gate text, monomial text, FROM ... WHERE ...) per gate."""
    parts = [f"SELECT {g} AS gate, {m} AS monomial {source}" for g, m, source in gates]
    body = " UNION ALL ".join(parts)
    return with_(*ctes, body=f"SELECT gate, monomial, count(*) AS coef FROM ({body}) GROUP BY gate, monomial")


def range_gates_sql(name: str, params: str, inner: str, op: str, keys: int) -> tuple[str, list[str]]:
    """CTEs and per-gate SELECTs of a range gate over codes that are not negative.

    ``params`` is a query of (gate, x, k0..), ``inner`` one of (y, monomial, k0..).
    """
    ks = [f"k{i}" for i in range(keys)]
    node = lambda b, p: gate(f"{name}N", *ks, b, p)
    above = "((x >> b) & 1) = 0 AND b < d OR b = d AND (x >> d) < (hi >> d)"
    below = "((x >> b) & 1) = 1 AND b < d OR b = d AND (x >> d) > (lo >> d)"
    side = {
        "<": [(above, "CASE WHEN b = d THEN hi >> d ELSE (x >> b) + 1 END")],
        ">": [(below, "CASE WHEN b = d THEN lo >> d ELSE (x >> b) - 1 END")],
    }
    side["<>"] = side["<"] + side[">"]
    side["<="] = [*side["<"], ("b = 0", "x")]
    side[">="] = [*side[">"], ("b = 0", "x")]
    ask = " UNION ALL ".join(
        f"SELECT gate, {node('b', p)} AS node FROM (SELECT *, unnest(range(d + 1)) AS b FROM {name}p, {name}b) WHERE {c}"
        for c, p in side[op]
    )
    asked = f"WHERE ({', '.join(ks)}) IN (SELECT ({', '.join(ks)}) FROM {name}p)" if ks else ""
    ctes = f"""{name}p AS (SELECT DISTINCT * FROM ({params})),
      {name}b AS (SELECT min(y) AS lo, max(y) AS hi, length(bin(xor(min(y), max(y)))) AS d FROM ({inner})),
      {name}i AS (SELECT * FROM ({inner}) {asked}),
      {name}n AS (SELECT {node('b', '(y >> b)')} AS node, monomial FROM
        (SELECT *, unnest(range(d + 1)) AS b FROM {name}i, {name}b)),
      {name}a AS ({ask})"""
    return ctes, [
        f"SELECT gate, node AS monomial FROM {name}a WHERE node IN (SELECT node FROM {name}n)",
        f"SELECT node AS gate, monomial FROM {name}n WHERE node IN (SELECT node FROM {name}a)",
    ]


def count_terms(*selects: str) -> str:
    return f"SELECT gate, monomial, count(*) AS coef FROM ({' UNION ALL '.join(selects)}) GROUP BY gate, monomial"
