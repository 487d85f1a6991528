"""The 13 SSB queries (joins and groupings without aggregates) on a star view of the tables.

``lineorder`` is lineitem widened by its order and keeps lineitem's token; ``date`` is
built from the order dates; customer and supplier carry nation and region names.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from whence.operators.frame import ProvFrame, join_all
from whence.operators.grouping import group
from whence.plans.base import Tables, circuit_sql, gate, prod, query, result, with_
from whence.sources.tokens import annotate_keys


def lineorder(t: Tables) -> ProvFrame:
    o = t.read("orders")
    order = o.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("lo_orderdate"))
    return t.lineitem.lookup(order, [("l_orderkey", "o_orderkey")], unique=True)


def dates(t: Tables) -> ProvFrame:
    day = F.col("day")
    df = t.read("orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    df = df.select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("d_datekey"),
        F.year(day).alias("d_year"),
        (F.year(day) * 100 + F.month(day)).alias("d_yearmonthnum"),
        F.weekofyear(day).alias("d_weeknuminyear"),
    )
    return annotate_keys(df, "D", ["d_datekey"])


def _located(t: Tables, frame: ProvFrame, key: str, prefix: str) -> ProvFrame:
    place = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = {"n_nationkey": f"{prefix}n", "n_name": f"{prefix}_nation", "r_name": f"{prefix}_region"}
    return frame.lookup(place.select(*[F.col(a).alias(b) for a, b in named.items()]), [(key, f"{prefix}n")], unique=True)


def customers(t: Tables) -> ProvFrame:
    return _located(t, t.customer, "c_nationkey", "c")


def suppliers(t: Tables) -> ProvFrame:
    return _located(t, t.supplier, "s_nationkey", "s")


VIEWS = (
    "lo AS (SELECT l.*, o_custkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS lo_orderdate"
    " FROM l JOIN orders ON l_orderkey = o_orderkey)",
    "d AS (SELECT *, 'D' || d_datekey AS dt FROM (SELECT DISTINCT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS d_datekey,"
    " CAST(year(o_orderdate) AS INTEGER) AS d_year, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS d_yearmonthnum,"
    " CAST(week(o_orderdate) AS INTEGER) AS d_weeknuminyear FROM orders))",
    "cl AS (SELECT c.*, n_name AS c_nation, r_name AS c_region FROM c JOIN nation ON c_nationkey = n_nationkey"
    " JOIN region ON n_regionkey = r_regionkey)",
    "sl AS (SELECT s.*, n_name AS s_nation, r_name AS s_region FROM s JOIN nation ON s_nationkey = n_nationkey"
    " JOIN region ON n_regionkey = r_regionkey)",
)
_FROM = {
    "lo": "lo",
    "d": "JOIN d ON lo_orderdate = d_datekey",
    "p": "JOIN p ON l_partkey = p_partkey",
    "s": "JOIN sl ON l_suppkey = s_suppkey",
    "c": "JOIN cl ON o_custkey = c_custkey",
}
_ON = {
    "d": ("lo_orderdate", "d_datekey"),
    "p": ("l_partkey", "p_partkey"),
    "s": ("l_suppkey", "s_suppkey"),
    "c": ("o_custkey", "c_custkey"),
}
_TOKEN = {"lo": "lt", "d": "dt", "p": "pt", "s": "st", "c": "ct"}


@cache
def _makers():
    return {"lo": lineorder, "d": dates, "p": lambda t: t.part, "s": suppliers, "c": customers}


def star(t: Tables, dims: str, where: str) -> ProvFrame:
    """lineorder joined with the dimensions named by one letter each, filtered."""
    frames = [lineorder(t), *[_makers()[x](t) for x in dims]]
    return join_all(frames, [_ON[x] for x in dims], F.expr(where))


def _register(number: str, dims: str, where: str, keys: tuple[str, ...] = ()) -> None:
    source = f"FROM {_FROM['lo']} {' '.join(_FROM[x] for x in dims)} WHERE {where}"
    token = prod("lt", *[_TOKEN[x] for x in dims])
    name = "ssb_q" + number.replace(".", "_")
    if not keys:
        sql = with_(*VIEWS, body=f"SELECT l_extendedprice, l_discount + 0.0::DOUBLE AS l_discount, {token} AS how {source}")

        def rows(t: Tables):
            f = star(t, dims, where).select("l_extendedprice", (F.col("l_discount") + F.lit(0.0)).alias("l_discount"))
            return result(f)

        query(name, sql)(rows)
        return
    gate_name = "S" + number

    def grouped(t: Tables) -> ProvFrame:
        return group(star(t, dims, where), list(keys), gate_name)

    g = gate(gate_name, *keys)
    listed = ", ".join(keys)
    query(name, with_(*VIEWS, body=f"SELECT {listed}, {g} AS how {source} GROUP BY {listed}"))(
        lambda t: result(grouped(t).order_by(*keys))
    )
    query(f"{name}_circuit", circuit_sql((g, token, source), ctes=VIEWS))(lambda t: grouped(t).circuit())


_register("1.1", "d", "d_year = 1996 and l_discount between 0.01 and 0.03 and l_quantity < 25")
_register("1.2", "d", "d_yearmonthnum = 199701 and l_discount between 0.04 and 0.06 and l_quantity between 26 and 35")
_register(
    "1.3",
    "d",
    "d_weeknuminyear = 6 and d_year = 1997 and l_discount between 0.05 and 0.07 and l_quantity between 26 and 35",
)
_BY_BRAND = ("d_year", "p_brand")
_register("2.1", "dps", "p_type = 'PROMO' and s_region = 'AMERICA'", _BY_BRAND)
_register("2.2", "dps", "p_brand between 'Brand#21' and 'Brand#25' and s_region = 'ASIA'", _BY_BRAND)
_register("2.3", "dps", "p_brand = 'Brand#21' and s_region = 'EUROPE'", _BY_BRAND)
_register(
    "3.1",
    "csd",
    "c_region = 'ASIA' and s_region = 'ASIA' and d_year >= 1995 and d_year <= 1999",
    ("c_nation", "s_nation", "d_year"),
)
_CITY = ("c_mktsegment", "s_name", "d_year")
_register(
    "3.2", "csd", "c_nation = 'NATION_3' and s_nation = 'NATION_3' and d_year >= 1995 and d_year <= 1999", _CITY
)
_PLACES = "c_nation in ('NATION_3', 'NATION_5') and (s_nation = 'NATION_3' or s_nation = 'NATION_5')"
_register("3.3", "csd", f"{_PLACES} and d_year >= 1995 and d_year <= 1999", _CITY)
_register("3.4", "csd", f"{_PLACES} and d_yearmonthnum = 199712", _CITY)
_TYPES = "(p_type = 'PROMO' or p_type = 'SMALL')"
_AMERICA = "c_region = 'AMERICA' and s_region = 'AMERICA'"
_register("4.1", "dcsp", f"{_AMERICA} and {_TYPES}", ("d_year", "c_nation"))
_register(
    "4.2", "dcsp", f"{_AMERICA} and (d_year = 1997 or d_year = 1998) and {_TYPES}", ("d_year", "s_nation", "p_type")
)
_register(
    "4.3",
    "dcsp",
    "c_region = 'AMERICA' and s_nation = 'NATION_1' and (d_year = 1997 or d_year = 1998) and p_type = 'PROMO'",
    ("d_year", "s_name", "p_brand"),
)
