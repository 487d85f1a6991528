"""The SSB+ queries: EXISTS, CTE, rank, top and bottom k, HAVING subquery.

``flat_lineorder`` is lineitem with all its dimensions, token of lineitem;
``flat_returns`` the returned lines with tokens ``FR<n>``; the social table is ``events``
with value as sentiment, event_type as country and user_id as part key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from whence.functions.aggregates import avg, count, sum_
from whence.operators.frame import ProvFrame
from whence.operators.grouping import group, having
from whence.operators.subquery import having_subquery, semi_join
from whence.plans.base import Tables, circuit_sql, dec, gate, mean, money, prod, query, result, volume, with_
from whence.sources.tokens import annotate_ordinal


def _flat(t: Tables, prefix: str) -> ProvFrame:
    o = t.read("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("od_year"))
    f = (
        annotate_ordinal(t.read("lineitem"), prefix)
        .lookup(o, [("l_orderkey", "o_orderkey")], unique=True)
        .lookup(t.read("part"), [("l_partkey", "p_partkey")], unique=True)
        .lookup(t.read("supplier"), [("l_suppkey", "s_suppkey")], unique=True)
        .lookup(t.read("customer"), [("o_custkey", "c_custkey")], unique=True)
    )
    place = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    for p in ("s", "c"):
        region = place.select(F.col("n_nationkey").alias(f"{p}n"), F.col("r_name").alias(f"{p}_region"))
        f = f.lookup(region, [(f"{p}_nationkey", f"{p}n")], unique=True)
    return f


def flat_lineorder(t: Tables) -> ProvFrame:
    return _flat(t, "L")


def flat_returns(t: Tables) -> ProvFrame:
    return _flat(t, "FR").filter("l_returnflag = 'R'")


def social(t: Tables) -> ProvFrame:
    return t.events.with_columns(hour=F.hour("ts"))


FLAT = """fl AS (SELECT l.*, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS od_year, p.*, s.*, c.*,
    sr.r_name AS s_region, cr.r_name AS c_region, 'F' || replace(lt, 'L', 'R') AS frt
  FROM l JOIN orders ON l_orderkey = o_orderkey JOIN part p ON l_partkey = p_partkey JOIN supplier s ON l_suppkey = s_suppkey
  JOIN customer c ON o_custkey = c_custkey JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN region sr ON sn.n_regionkey = sr.r_regionkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN region cr ON cn.n_regionkey = cr.r_regionkey)"""
RETURNS = "fr AS (SELECT * FROM fl WHERE l_returnflag = 'R')"
SOCIAL = "so AS (SELECT *, CAST(hour(ts) AS INTEGER) AS hr FROM e)"
FLATS = (FLAT, RETURNS)

# ---- #5 sales of suppliers with returns ---------------------------------------

YEARS = "(1999, 1998, 1997, 1996)"


def q5(t: Tables) -> ProvFrame:
    sold = flat_lineorder(t).filter(f"od_year in {YEARS}")
    returned = flat_returns(t).filter(f"c_region = 'AMERICA' and od_year in {YEARS}").prefixed("i_")
    f = semi_join(sold, returned, [("s_suppkey", "i_s_suppkey")], "SP5E")
    return group(f, ["s_name"], "SP5", {"quantity": sum_(money("l_quantity"))})


Q5 = f"""FROM fl WHERE od_year IN {YEARS} AND EXISTS (SELECT * FROM fr WHERE fr.c_region = 'AMERICA'
  AND fr.od_year IN {YEARS} AND fl.s_suppkey = fr.s_suppkey)"""
query("ssbplus_q5", with_(*FLATS, body=f"""SELECT s_name, CAST(sum({dec('l_quantity')}) AS DOUBLE) AS quantity,
  {gate('SP5', 's_name')} AS how {Q5} GROUP BY s_name ORDER BY quantity DESC, s_name LIMIT 20"""))(
    lambda t: result(q5(t).order_by(F.desc("quantity"), "s_name").limit(20))
)
query(
    "ssbplus_q5_circuit",
    circuit_sql(
        (gate("SP5", "s_name"), prod("lt", gate("SP5E", "s_suppkey")), Q5),
        (gate("SP5E", "s_suppkey"), "frt", f"FROM fr WHERE c_region = 'AMERICA' AND od_year IN {YEARS}"),
        ctes=FLATS,
    ),
)(lambda t: q5(t).circuit())

# ---- #6 parts returned more than once -----------------------------------------


def q6(t: Tables, tag: str, where: str) -> ProvFrame:
    found = group(flat_returns(t).filter(where).prefixed("i_"), ["i_p_partkey"], f"{tag}R", {"i_n": count()})
    found = having(found, "i_n", ">", 1)
    f = semi_join(flat_lineorder(t).filter(where), found, [("p_partkey", "i_p_partkey")], f"{tag}E")
    g = group(f, ["p_name", "p_type"], tag, {"count": count(), "price": avg(money("l_extendedprice"))})
    return having(g, "price", ">", 1000)


def _q6_sql(tag: str, where: str, tail: str) -> str:
    return with_(*FLATS, f"found AS (SELECT p_partkey AS partkey, count(1) AS n FROM fr WHERE {where} GROUP BY p_partkey)",
        body=f"""SELECT p_name, p_type, count(1) AS count, {mean('l_extendedprice')} AS price, {gate(tag, 'p_name', 'p_type')} AS how
        FROM fl WHERE {where} AND EXISTS (SELECT * FROM found WHERE fl.p_partkey = partkey AND n > 1)
        GROUP BY p_name, p_type HAVING {mean('l_extendedprice')} > 1000 {tail}""")


Q61 = "p_type = 'PROMO' AND s_region = 'ASIA' AND c_region = 'AMERICA'"
query("ssbplus_q6_1", _q6_sql("SP61", Q61, ""))(lambda t: result(q6(t, "SP61", Q61)))
query("ssbplus_q6_2", _q6_sql("SP62", "true", "ORDER BY count DESC, p_name, p_type LIMIT 10"))(
    lambda t: result(q6(t, "SP62", "true").order_by(F.desc("count"), "p_name", "p_type").limit(10))
)

# ---- #7 best parts per market segment -----------------------------------------


def q7(t: Tables) -> ProvFrame:
    g = group(flat_lineorder(t), ["p_name", "c_mktsegment"], "SP7", {"revenue": sum_(volume())})
    return g.top_per_group(["c_mktsegment"], ["revenue desc"], 5)


VOL = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
query("ssbplus_q7", with_(FLAT, body=f"""SELECT p_name, c_mktsegment, CAST(revenue AS DOUBLE) AS revenue, rank,
  {gate('SP7', 'p_name', 'c_mktsegment')} AS how FROM (SELECT *, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY revenue DESC)
  AS INTEGER) AS rank FROM (SELECT p_name, c_mktsegment, sum({VOL}) AS revenue FROM fl GROUP BY p_name, c_mktsegment))
  WHERE rank <= 5"""))(lambda t: result(q7(t)))
query("ssbplus_q7_circuit", circuit_sql((gate("SP7", "p_name", "c_mktsegment"), "lt", "FROM fl"), ctes=(FLAT,)))(
    lambda t: q7(t).circuit()
)

# ---- #8 happiest and saddest countries ----------------------------------------


def q8(t: Tables, source: ProvFrame, tag: str) -> ProvFrame:
    by_country = group(source, ["event_type"], tag, {"sent": avg(money("value"))})
    top = by_country.order_by(F.desc("sent"), "event_type").limit(2)
    bottom = by_country.order_by(F.asc("sent"), "event_type").limit(2)
    return top.union_all(bottom)


def _q8_sql(tag: str, source: str) -> str:
    return with_(SOCIAL, f"""w AS (SELECT event_type, {mean('value')} AS sent, {gate(tag, 'event_type')} AS how
      {source} GROUP BY event_type)""", body="""SELECT * FROM (SELECT * FROM w ORDER BY sent DESC, event_type LIMIT 2)
      UNION ALL (SELECT * FROM w ORDER BY sent ASC, event_type LIMIT 2)""")


query("ssbplus_q8_1", _q8_sql("SP81", "FROM so"))(lambda t: result(q8(t, social(t), "SP81")))
query("ssbplus_q8_2", _q8_sql("SP82", "FROM so JOIN p ON user_id = p_partkey"))(
    lambda t: result(q8(t, social(t).join(t.part, [("user_id", "p_partkey")]), "SP82"))
)
query("ssbplus_q8_1_circuit", circuit_sql((gate("SP81", "event_type"), "et", "FROM so"), ctes=(SOCIAL,)))(
    lambda t: q8(t, social(t), "SP81").circuit()
)
query(
    "ssbplus_q8_2_circuit",
    circuit_sql((gate("SP82", "event_type"), prod("et", "pt"), "FROM so JOIN p ON user_id = p_partkey"), ctes=(SOCIAL,)),
)(lambda t: q8(t, social(t).join(t.part, [("user_id", "p_partkey")]), "SP82").circuit())

# ---- #9 mentions by day period --------------------------------------------------

PERIOD = """CASE WHEN {h} >= 0 AND {h} <= 6 THEN 'Dawn' WHEN {h} > 6 AND {h} <= 12 THEN 'Morning'
  WHEN {h} > 12 AND {h} <= 18 THEN 'Afternoon' WHEN {h} > 18 AND {h} <= 23 THEN 'Night' ELSE NULL END"""
COUNTRIES = "(event_type = 'click' or event_type = 'view')"


def q9_joined(t: Tables) -> ProvFrame:
    f = social(t).filter(COUNTRIES).join(t.part, [("user_id", "p_partkey")])
    g = group(f, ["hour", "p_type"], "SP91", {"count": count("value")})
    return g.with_columns(day_period=F.expr(PERIOD.format(h="hour")))


def q9_flat(t: Tables) -> ProvFrame:
    g = group(social(t).filter(COUNTRIES), ["hour", "event_type"], "SP92", {"count": count("value")})
    return g.with_columns(day_period=F.expr(PERIOD.format(h="hour")))


Q91 = f"FROM so JOIN p ON user_id = p_partkey WHERE {COUNTRIES}"
query("ssbplus_q9_1", with_(SOCIAL, body=f"""SELECT hr AS hour, p_type, count(value) AS count, {PERIOD.format(h='hr')} AS day_period,
  {gate('SP91', 'hr', 'p_type')} AS how {Q91} GROUP BY hr, p_type"""))(lambda t: result(q9_joined(t)))
query("ssbplus_q9_1_circuit", circuit_sql((gate("SP91", "hr", "p_type"), prod("et", "pt"), Q91), ctes=(SOCIAL,)))(
    lambda t: q9_joined(t).circuit()
)
query("ssbplus_q9_2", with_(SOCIAL, body=f"""SELECT hr AS hour, event_type, count(value) AS count, {PERIOD.format(h='hr')} AS day_period,
  {gate('SP92', 'hr', 'event_type')} AS how FROM so WHERE {COUNTRIES} GROUP BY hr, event_type"""))(
    lambda t: result(q9_flat(t))
)

# ---- #10 groups above the overall mean ----------------------------------------


def q10(t: Tables, source: ProvFrame, keys: list[str], tag: str) -> ProvFrame:
    g = group(source, keys, tag, {"sent": avg(money("value"))})
    return having_subquery(g, "sent", ">", social(t).prefixed("i_"), avg(money("i_value")), f"{tag}A")


def _q10_sql(tag: str, source: str, keys: list[str]) -> str:
    listed = ", ".join(keys)
    how = prod(gate(tag, *keys), f"'{tag}A[]'")
    return with_(SOCIAL, body=f"""SELECT {listed}, {mean('value')} AS sent, {how} AS how {source} GROUP BY {listed}
      HAVING {mean('value')} > (SELECT {mean('value')} FROM so)""")


K101, K102 = ["event_type", "hour"], ["p_type", "event_type"]
query("ssbplus_q10_1", _q10_sql("SP101", "FROM (SELECT * REPLACE (CAST(hr AS INTEGER) AS hr), hr AS hour FROM so)", K101))(
    lambda t: result(q10(t, social(t), K101, "SP101"))
)
query("ssbplus_q10_2", _q10_sql("SP102", "FROM so JOIN p ON user_id = p_partkey", K102))(
    lambda t: result(q10(t, social(t).join(t.part, [("user_id", "p_partkey")]), K102, "SP102"))
)
query(
    "ssbplus_q10_2_circuit",
    circuit_sql(
        (gate("SP102", *K102), prod("et", "pt"), "FROM so JOIN p ON user_id = p_partkey"),
        ("'SP102A[]'", "et", "FROM so"),
        ctes=(SOCIAL,),
    ),
)(lambda t: q10(t, social(t).join(t.part, [("user_id", "p_partkey")]), K102, "SP102").circuit())
