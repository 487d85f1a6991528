"""The 22 TPC-H queries on the given star tables, with provenance.

Constants are adapted to the data and absent columns are dropped or replaced.  Each
query gives its rows with ``how``; where it groups, ``<name>_circuit`` gives the gates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from whence.functions.aggregates import avg, count, count_distinct, max_, min_, sum_
from whence.operators.frame import ProvFrame, join_all
from whence.operators.grouping import group, having
from whence.operators.subquery import anti_join, having_subquery, in_, not_in, scalar_compare, semi_join
from whence.plans.base import (
    VOLUME,
    Tables,
    circuit_sql,
    count_terms,
    dec,
    gate,
    mean,
    money,
    prod,
    query,
    range_gates_sql,
    result,
    volume,
    with_,
)

# ---- Q1 pricing summary ------------------------------------------------------


def q1(t: Tables) -> ProvFrame:
    li = t.lineitem.filter("l_shipdate <= timestamp_ntz'1998-12-01' - interval 78 day")
    charge = volume() * (F.lit(1) + F.col("l_tax").cast("decimal(4,2)"))
    aggs = {
        "sum_qty": sum_(money("l_quantity")),
        "sum_base_price": sum_(money("l_extendedprice")),
        "sum_disc_price": sum_(volume()),
        "sum_charge": sum_(charge),
        "avg_qty": avg(money("l_quantity")),
        "avg_price": avg(money("l_extendedprice")),
        "avg_disc": avg(money("l_discount")),
        "count_order": count(),
    }
    return group(li, ["l_returnflag", "l_linestatus"], "Q1", aggs)


Q1 = "FROM l WHERE l_shipdate <= TIMESTAMP '1998-12-01' - INTERVAL 78 DAY"
Q1_GATE = gate("Q1", "l_returnflag", "l_linestatus")
query("tpch_q1", with_(body=f"""SELECT l_returnflag, l_linestatus,
  CAST(sum({dec('l_quantity')}) AS DOUBLE) AS sum_qty, CAST(sum({dec('l_extendedprice')}) AS DOUBLE) AS sum_base_price,
  CAST(sum({VOLUME}) AS DOUBLE) AS sum_disc_price,
  CAST(sum({VOLUME} * (1 + CAST(l_tax AS DECIMAL(4,2)))) AS DOUBLE) AS sum_charge,
  {mean('l_quantity')} AS avg_qty, {mean('l_extendedprice')} AS avg_price, {mean('l_discount')} AS avg_disc,
  count(*) AS count_order, {Q1_GATE} AS how {Q1} GROUP BY l_returnflag, l_linestatus"""))(
    lambda t: result(q1(t).order_by("l_returnflag", "l_linestatus"))
)
query("tpch_q1_circuit", circuit_sql((Q1_GATE, "lt", Q1)))(lambda t: q1(t).circuit())

# ---- Q2 minimum cost supplier --------------------------------------------------


def q2(t: Tables) -> ProvFrame:
    asia = t.region.filter("r_name = 'ASIA'")
    inner = join_all(
        [f.prefixed("i_") for f in (t.partsupp, t.supplier, t.nation, asia)],
        [("i_s_suppkey", "i_ps_suppkey"), ("i_s_nationkey", "i_n_nationkey"), ("i_n_regionkey", "i_r_regionkey")],
    )
    outer = join_all(
        [t.part.filter("p_size < 15 and p_type like '%ARD'"), t.partsupp, t.supplier, t.nation, asia],
        [
            ("p_partkey", "ps_partkey"),
            ("s_suppkey", "ps_suppkey"),
            ("s_nationkey", "n_nationkey"),
            ("n_regionkey", "r_regionkey"),
        ],
    )
    best = scalar_compare(
        outer, "ps_supplycost", "=", inner, min_("i_ps_supplycost"), "Q2", [("p_partkey", "i_ps_partkey")]
    )
    return best.select("s_acctbal", "s_name", "n_name", "p_partkey")


Q2_INNER = """FROM ps JOIN s ON s_suppkey = ps_suppkey JOIN n ON s_nationkey = n_nationkey
  JOIN r ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"""
query("tpch_q2", with_(body=f"""SELECT s_acctbal, s_name, n_name, p_partkey,
  {prod('pt', 'pst', 'st', 'nt', 'rt', gate('Q2', 'p_partkey'))} AS how
  FROM p, s, ps, n, r WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size < 15 AND p_type LIKE '%ARD'
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
  AND ps_supplycost = (SELECT min(b.ps_supplycost) FROM ps b, s b2, n b3, r b4 WHERE p_partkey = b.ps_partkey
    AND b2.s_suppkey = b.ps_suppkey AND b2.s_nationkey = b3.n_nationkey AND b3.n_regionkey = b4.r_regionkey
    AND b4.r_name = 'ASIA') ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100"""))(
    lambda t: result(q2(t).order_by(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey").limit(100))
)
query("tpch_q2_circuit", circuit_sql((gate("Q2", "ps_partkey"), prod("pst", "st", "nt", "rt"), Q2_INNER)))(
    lambda t: q2(t).circuit()
)

# ---- Q3 shipping priority ------------------------------------------------------


def q3(t: Tables) -> ProvFrame:
    f = join_all(
        [
            t.customer.filter("c_mktsegment = 'FURNITURE'"),
            t.orders.filter("o_orderdate < timestamp_ntz'1998-03-17'"),
            t.lineitem.filter("l_shipdate > timestamp_ntz'1998-03-17'"),
        ],
        [("c_custkey", "o_custkey"), ("l_orderkey", "o_orderkey")],
    )
    return group(f, ["l_orderkey", "o_orderdate"], "Q3", {"revenue": sum_(volume())})


Q3 = """FROM c JOIN o ON c_custkey = o_custkey JOIN l ON l_orderkey = o_orderkey WHERE c_mktsegment = 'FURNITURE'
  AND o_orderdate < TIMESTAMP '1998-03-17' AND l_shipdate > TIMESTAMP '1998-03-17'"""
Q3_GATE = gate("Q3", "l_orderkey", "o_orderdate")
query("tpch_q3", with_(body=f"""SELECT l_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate,
  CAST(sum({VOLUME}) AS DOUBLE) AS revenue, {Q3_GATE} AS how {Q3} GROUP BY l_orderkey, o.o_orderdate
  ORDER BY sum({VOLUME}) DESC, o.o_orderdate, l_orderkey LIMIT 10"""))(
    lambda t: result(q3(t).order_by(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10))
)
query("tpch_q3_circuit", circuit_sql((Q3_GATE, prod("ct", "ot", "lt"), Q3)))(lambda t: q3(t).circuit())

# ---- Q4 order priority checking ------------------------------------------------


def q4(t: Tables) -> ProvFrame:
    recent = t.orders.filter(
        "o_orderdate >= timestamp_ntz'1995-08-01' and o_orderdate < timestamp_ntz'1995-08-01' + interval 3 month"
    )
    returned = t.lineitem.filter("l_returnflag = 'R'")
    f = semi_join(recent, returned, [("o_orderkey", "l_orderkey")], "Q4E")
    return group(f, ["o_orderpriority"], "Q4", {"order_count": count()})


Q4 = """FROM o WHERE o_orderdate >= TIMESTAMP '1995-08-01' AND o_orderdate < TIMESTAMP '1995-11-01'
  AND EXISTS (SELECT * FROM l WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"""
query("tpch_q4", with_(body=f"""SELECT o_orderpriority, count(*) AS order_count, {gate('Q4', 'o_orderpriority')} AS how
  {Q4} GROUP BY o_orderpriority"""))(lambda t: result(q4(t).order_by("o_orderpriority")))
query(
    "tpch_q4_circuit",
    circuit_sql(
        (gate("Q4", "o_orderpriority"), prod("ot", gate("Q4E", "o_orderkey")), Q4),
        (gate("Q4E", "l_orderkey"), "lt", f"FROM l WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey {Q4})"),
    ),
)(lambda t: q4(t).circuit(reachable=True))

# ---- Q5 local supplier volume --------------------------------------------------


def q5(t: Tables) -> ProvFrame:
    f = join_all(
        [
            t.customer,
            t.orders.filter("o_orderdate >= timestamp_ntz'1995-01-01' and o_orderdate < timestamp_ntz'1996-01-01'"),
            t.lineitem,
            t.supplier,
            t.nation,
            t.region.filter("r_name = 'EUROPE'"),
        ],
        [
            ("c_custkey", "o_custkey"),
            ("l_orderkey", "o_orderkey"),
            ("l_suppkey", "s_suppkey"),
            ("c_nationkey", "s_nationkey"),
            ("s_nationkey", "n_nationkey"),
            ("n_regionkey", "r_regionkey"),
        ],
    )
    return group(f, ["n_name"], "Q5", {"revenue": sum_(volume())})


Q5 = """FROM c, o, l, s, n, r WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
  AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
  AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'"""
query("tpch_q5", with_(body=f"""SELECT n_name, CAST(sum({VOLUME}) AS DOUBLE) AS revenue, {gate('Q5', 'n_name')} AS how
  {Q5} GROUP BY n_name"""))(lambda t: result(q5(t).order_by(F.desc("revenue"))))
query("tpch_q5_circuit", circuit_sql((gate("Q5", "n_name"), prod("ct", "ot", "lt", "st", "nt", "rt"), Q5)))(
    lambda t: q5(t).circuit()
)

# ---- Q6 forecasting revenue change ---------------------------------------------


def q6(t: Tables) -> ProvFrame:
    f = t.lineitem.filter(
        "l_shipdate >= timestamp_ntz'1996-01-01' and l_shipdate < timestamp_ntz'1996-01-01' + interval 1 year"
    ).filter(F.col("l_discount").between(0.08, 0.1) & (F.col("l_quantity") < 24))
    return group(f, [], "Q6", {"revenue": sum_(money("l_extendedprice") * money("l_discount"))})


Q6 = """FROM l WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
  AND l_discount BETWEEN CAST(0.08 AS DOUBLE) AND CAST(0.1 AS DOUBLE) AND l_quantity < 24"""
Q6_VALUE = f"{dec('l_extendedprice')} * {dec('l_discount')}"
query("tpch_q6", with_(body=f"SELECT CAST(sum({Q6_VALUE}) AS DOUBLE) AS revenue, 'Q6[]' AS how {Q6}"))(
    lambda t: result(q6(t))
)
query("tpch_q6_tensor", with_(body=f"""SELECT 'Q6[]' AS gate, lt AS monomial,
  CAST(CAST({Q6_VALUE} AS DECIMAL(24,4)) AS VARCHAR) AS value, count(*) AS coef {Q6} GROUP BY ALL"""))(
    lambda t: q6(t).tensor("revenue")
)

# ---- Q7 volume shipping --------------------------------------------------------


def q7(t: Tables) -> ProvFrame:
    n1, n2 = t.nation.prefixed("n1_"), t.nation.prefixed("n2_")
    f = join_all(
        [
            t.supplier,
            t.lineitem.filter("l_shipdate between timestamp_ntz'1995-01-01' and timestamp_ntz'1996-12-31'"),
            t.orders,
            t.customer,
            n1.rename({"n1_n_name": "supp_nation"}),
            n2.rename({"n2_n_name": "cust_nation"}),
        ],
        [
            ("s_suppkey", "l_suppkey"),
            ("o_orderkey", "l_orderkey"),
            ("c_custkey", "o_custkey"),
            ("s_nationkey", "n1_n_nationkey"),
            ("c_nationkey", "n2_n_nationkey"),
        ],
        F.expr(
            "(supp_nation = 'NATION_1' and cust_nation = 'NATION_2')"
            " or (supp_nation = 'NATION_2' and cust_nation = 'NATION_1')"
        ),
    )
    f = f.with_columns(l_year=F.year("l_shipdate"))
    return group(f, ["supp_nation", "cust_nation", "l_year"], "Q7", {"revenue": sum_(volume())})


Q7 = """FROM (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS l_year, n1.n_name AS supp_nation, n2.n_name AS cust_nation,
    n1.nt AS n1t, n2.nt AS n2t
  FROM s, l, o, c, n n1, n n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey
  AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2')
  OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
  AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31')"""
Q7_GATE = gate("Q7", "supp_nation", "cust_nation", "l_year")
query("tpch_q7", with_(body=f"""SELECT supp_nation, cust_nation, l_year, CAST(sum({VOLUME}) AS DOUBLE) AS revenue,
  {Q7_GATE} AS how {Q7} GROUP BY supp_nation, cust_nation, l_year"""))(
    lambda t: result(q7(t).order_by("supp_nation", "cust_nation", "l_year"))
)
query("tpch_q7_circuit", circuit_sql((Q7_GATE, prod("st", "lt", "ot", "ct", "n1t", "n2t"), Q7)))(
    lambda t: q7(t).circuit()
)

# ---- Q8 national market share --------------------------------------------------


def q8(t: Tables) -> ProvFrame:
    f = join_all(
        [
            t.part.filter("p_type = 'STANDARD'"),
            t.lineitem,
            t.supplier,
            t.orders.filter("o_orderdate between timestamp_ntz'1995-01-01' and timestamp_ntz'1996-12-31'"),
            t.customer,
            t.nation.prefixed("n1_"),
            t.region.filter("r_name = 'MIDDLE EAST'"),
            t.nation.prefixed("n2_"),
        ],
        [
            ("p_partkey", "l_partkey"),
            ("s_suppkey", "l_suppkey"),
            ("l_orderkey", "o_orderkey"),
            ("o_custkey", "c_custkey"),
            ("c_nationkey", "n1_n_nationkey"),
            ("n1_n_regionkey", "r_regionkey"),
            ("s_nationkey", "n2_n_nationkey"),
        ],
    ).with_columns(o_year=F.year("o_orderdate"))
    own = F.when(F.col("n2_n_name") == "NATION_4", volume()).otherwise(F.lit(0))
    g = group(f, ["o_year"], "Q8", {"own": sum_(own), "total": sum_(volume())})
    return g.with_columns(mkt_share=F.col("own").cast("double") / F.col("total").cast("double"))


Q8 = """FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS o_year, n2.n_name AS nation, n1.nt AS n1t, n2.nt AS n2t
  FROM p, s, l, o, c, n n1, n n2, r WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey
  AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'MIDDLE EAST'
  AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'
  AND p_type = 'STANDARD')"""
Q8_OWN = f"sum(CASE WHEN nation = 'NATION_4' THEN {VOLUME} ELSE 0 END)"
query("tpch_q8", with_(body=f"""SELECT o_year, CAST({Q8_OWN} AS DOUBLE) AS own, CAST(sum({VOLUME}) AS DOUBLE) AS total,
  CAST({Q8_OWN} AS DOUBLE) / CAST(sum({VOLUME}) AS DOUBLE) AS mkt_share, {gate('Q8', 'o_year')} AS how {Q8} GROUP BY o_year"""))(
    lambda t: result(q8(t).order_by("o_year"))
)
query("tpch_q8_circuit", circuit_sql((gate("Q8", "o_year"), prod("pt", "st", "lt", "ot", "ct", "n1t", "n2t", "rt"), Q8)))(
    lambda t: q8(t).circuit()
)

# ---- Q9 product type profit ----------------------------------------------------


def q9(t: Tables) -> ProvFrame:
    f = join_all(
        [t.part.filter("p_name like '%ring%'"), t.lineitem, t.supplier, t.partsupp, t.orders, t.nation],
        [
            ("p_partkey", "l_partkey"),
            ("s_suppkey", "l_suppkey"),
            ("ps_suppkey", "l_suppkey"),
            ("ps_partkey", "l_partkey"),
            ("o_orderkey", "l_orderkey"),
            ("s_nationkey", "n_nationkey"),
        ],
    ).with_columns(o_year=F.year("o_orderdate"))
    amount = volume() - F.col("ps_supplycost") * money("l_quantity")
    return group(f, ["n_name", "o_year"], "Q9", {"sum_profit": sum_(amount)})


Q9 = """FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS o_year FROM p, s, l, ps, o, n
  WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey
  AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%ring%')"""
query("tpch_q9", with_(body=f"""SELECT n_name, o_year,
  CAST(sum({VOLUME} - ps_supplycost * {dec('l_quantity')}) AS DOUBLE) AS sum_profit, {gate('Q9', 'n_name', 'o_year')} AS how
  {Q9} GROUP BY n_name, o_year"""))(lambda t: result(q9(t).order_by("n_name", F.desc("o_year"))))
query(
    "tpch_q9_circuit",
    circuit_sql((gate("Q9", "n_name", "o_year"), prod("pt", "st", "lt", "pst", "ot", "nt"), Q9)),
)(lambda t: q9(t).circuit())

# ---- Q10 returned items --------------------------------------------------------


def q10(t: Tables) -> ProvFrame:
    f = join_all(
        [
            t.customer,
            t.orders.filter(
                "o_orderdate >= timestamp_ntz'1995-11-01' and o_orderdate < timestamp_ntz'1995-11-01' + interval 3 month"
            ),
            t.lineitem.filter("l_returnflag = 'R'"),
            t.nation,
        ],
        [("c_custkey", "o_custkey"), ("l_orderkey", "o_orderkey"), ("c_nationkey", "n_nationkey")],
    )
    g = group(f, ["c_custkey", "c_name", "c_acctbal", "n_name"], "Q10", {"revenue": sum_(volume())})
    return g


Q10 = """FROM c, o, l, n WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R'
  AND c_nationkey = n_nationkey AND o_orderdate >= TIMESTAMP '1995-11-01' AND o_orderdate < TIMESTAMP '1996-02-01'"""
Q10_GATE = gate("Q10", "c_custkey", "c_name", "c_acctbal", "n_name")
query("tpch_q10", with_(body=f"""SELECT c_custkey, c_name, c_acctbal, n_name, CAST(sum({VOLUME}) AS DOUBLE) AS revenue,
  {Q10_GATE} AS how {Q10} GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY sum({VOLUME}) DESC, c_custkey LIMIT 20"""))(
    lambda t: result(q10(t).order_by(F.desc("revenue"), "c_custkey").limit(20))
)
query("tpch_q10_circuit", circuit_sql((Q10_GATE, prod("ct", "ot", "lt", "nt"), Q10)))(lambda t: q10(t).circuit())

# ---- Q11 important stock -------------------------------------------------------


def q11(t: Tables, mode: str = "resolved") -> ProvFrame:
    stock = join_all(
        [t.partsupp, t.supplier, t.nation.filter("n_name = 'NATION_7'")],
        [("ps_suppkey", "s_suppkey"), ("s_nationkey", "n_nationkey")],
    )
    worth = F.col("ps_supplycost") * F.col("ps_availqty")
    g = group(stock, ["ps_partkey"], "Q11", {"value": sum_(worth)})
    return having_subquery(g, "value", ">", stock, sum_(worth, scale=0.001), "Q11T", mode)


Q11 = "FROM ps, s, n WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7'"
Q11_SUM = "CAST(sum(ps_supplycost * ps_availqty) AS DOUBLE)"
query("tpch_q11", with_(body=f"""SELECT ps_partkey, {Q11_SUM} AS value,
  {prod(gate('Q11', 'ps_partkey'), "'Q11T[]'")} AS how {Q11} GROUP BY ps_partkey
  HAVING {Q11_SUM} > (SELECT {Q11_SUM} * 0.001 {Q11})"""))(lambda t: result(q11(t).order_by(F.desc("value"), "ps_partkey")))
query(
    "tpch_q11_circuit",
    circuit_sql(
        (gate("Q11", "ps_partkey"), prod("pst", "st", "nt"), Q11), ("'Q11T[]'", prod("pst", "st", "nt"), Q11)
    ),
)(lambda t: q11(t).circuit())

# ---- Q12 shipping modes and order priority -------------------------------------


def q12(t: Tables) -> ProvFrame:
    f = t.orders.join(
        t.lineitem.filter(
            "l_returnflag in ('A', 'N') and l_shipdate >= timestamp_ntz'1996-01-01' and l_shipdate < timestamp_ntz'1997-01-01'"
        ),
        [("o_orderkey", "l_orderkey")],
    )
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return group(
        f,
        ["l_linestatus"],
        "Q12",
        {"high_line_count": sum_(F.when(high, 1).otherwise(0)), "low_line_count": sum_(F.when(~high, 1).otherwise(0))},
    )


Q12 = """FROM o, l WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'N')
  AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'"""
query("tpch_q12", with_(body=f"""SELECT l_linestatus,
  CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count,
  {gate('Q12', 'l_linestatus')} AS how {Q12} GROUP BY l_linestatus"""))(lambda t: result(q12(t).order_by("l_linestatus")))
query("tpch_q12_circuit", circuit_sql((gate("Q12", "l_linestatus"), prod("ot", "lt"), Q12)))(lambda t: q12(t).circuit())

# ---- Q13 customer distribution -------------------------------------------------


def q13(t: Tables) -> ProvFrame:
    some = t.orders.filter("o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1996-07-01'")
    f = t.customer.join(some, [("c_custkey", "o_custkey")], "left")
    per_customer = group(f, ["c_custkey"], "Q13C", {"n": count("o_orderkey")}).to_columns("c_custkey", "c_count")
    return group(per_customer, ["c_count"], "Q13", {"custdist": count()})


Q13 = """FROM c LEFT JOIN o ON c_custkey = o_custkey AND o_orderdate >= TIMESTAMP '1996-01-01'
  AND o_orderdate < TIMESTAMP '1996-07-01'"""
Q13_INNER = f"(SELECT c_custkey, count(o_orderkey) AS c_count {Q13} GROUP BY c_custkey)"
query("tpch_q13", with_(body=f"""SELECT c_count, count(*) AS custdist, {gate('Q13', 'c_count')} AS how
  FROM {Q13_INNER} GROUP BY c_count"""))(lambda t: result(q13(t).order_by(F.desc("custdist"), F.desc("c_count"))))
query(
    "tpch_q13_circuit",
    circuit_sql(
        (gate("Q13", "c_count"), gate("Q13C", "c_custkey"), f"FROM {Q13_INNER}"),
        (gate("Q13C", "c_custkey"), f"CASE WHEN ot IS NULL THEN ct ELSE {prod('ct', 'ot')} END", Q13),
    ),
)(lambda t: q13(t).circuit())
query("tpch_q13_tensor", with_(body=f"""SELECT {gate('Q13C', 'c_custkey')} AS gate,
  CASE WHEN ot IS NULL THEN ct ELSE {prod('ct', 'ot')} END AS monomial,
  CASE WHEN o_orderkey IS NULL THEN '0' ELSE '1' END AS value, count(*) AS coef {Q13} GROUP BY ALL"""))(
    lambda t: q13(t).tensor("n", "Q13C")
)

# ---- Q14 promotion effect ------------------------------------------------------


def q14(t: Tables) -> ProvFrame:
    f = t.lineitem.filter("l_shipdate >= timestamp_ntz'1996-10-01' and l_shipdate < timestamp_ntz'1996-11-01'").join(
        t.part, [("l_partkey", "p_partkey")]
    )
    promo = F.when(F.col("p_type").like("PROMO%"), volume()).otherwise(F.lit(0))
    g = group(f, [], "Q14", {"promo": sum_(promo, scale=100), "total": sum_(volume())})
    return g.with_columns(promo_revenue=F.col("promo").cast("double") / F.col("total").cast("double"))


Q14 = """FROM l, p WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1996-10-01'
  AND l_shipdate < TIMESTAMP '1996-11-01'"""
Q14_PROMO = f"CAST(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {VOLUME} ELSE 0 END) AS DOUBLE)"
query("tpch_q14", with_(body=f"""SELECT {Q14_PROMO} AS promo, CAST(sum({VOLUME}) AS DOUBLE) AS total,
  {Q14_PROMO} / CAST(sum({VOLUME}) AS DOUBLE) AS promo_revenue, 'Q14[]' AS how {Q14}"""))(lambda t: result(q14(t)))
query("tpch_q14_circuit", circuit_sql(("'Q14[]'", prod("lt", "pt"), Q14)))(lambda t: q14(t).circuit())

# ---- Q15 top supplier ----------------------------------------------------------


def q15(t: Tables) -> ProvFrame:
    quarter = t.lineitem.filter("l_shipdate >= timestamp_ntz'1996-03-01' and l_shipdate < timestamp_ntz'1996-06-01'")
    view = group(quarter, ["l_suppkey"], "Q15V", {"total_revenue": sum_(volume())})
    f = t.supplier.join(view, [("s_suppkey", "l_suppkey")])
    best = scalar_compare(f, "total_revenue", "=", view, max_("total_revenue"), "Q15M")
    return best.select("s_suppkey", "s_name", "total_revenue")


Q15 = "FROM l WHERE l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-06-01'"
Q15_VIEW = f"q15v AS (SELECT l_suppkey, sum({VOLUME}) AS total_revenue {Q15} GROUP BY l_suppkey)"
query("tpch_q15", with_(Q15_VIEW, body=f"""SELECT s_suppkey, s_name, CAST(total_revenue AS DOUBLE) AS total_revenue,
  {prod('st', gate('Q15V', 'l_suppkey'), "'Q15M[]'")} AS how FROM s JOIN q15v ON s_suppkey = l_suppkey
  WHERE q15v.total_revenue = (SELECT max(total_revenue) FROM q15v)"""))(lambda t: result(q15(t).order_by("s_suppkey")))
query(
    "tpch_q15_circuit",
    circuit_sql(
        (gate("Q15V", "l_suppkey"), "lt", Q15), ("'Q15M[]'", gate("Q15V", "l_suppkey"), "FROM q15v"), ctes=(Q15_VIEW,)
    ),
)(lambda t: q15(t).circuit())

# ---- Q16 parts/supplier relationship -------------------------------------------


def q16(t: Tables) -> ProvFrame:
    f = t.partsupp.join(
        t.part.filter(
            "p_brand <> 'Brand#12' and p_type not like 'STANDARD%' and p_size in (44, 31, 46, 26, 49, 29, 34, 38)"
        ),
        [("ps_partkey", "p_partkey")],
    )
    f = not_in(f, t.supplier.filter("s_acctbal < 0"), "ps_suppkey", "s_suppkey")
    return group(f, ["p_brand", "p_type", "p_size"], "Q16", {"supplier_cnt": count_distinct("ps_suppkey")})


Q16 = """FROM ps, p WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#12' AND p_type NOT LIKE 'STANDARD%'
  AND p_size IN (44, 31, 46, 26, 49, 29, 34, 38) AND ps_suppkey NOT IN (SELECT s_suppkey FROM s WHERE s_acctbal < 0)"""
Q16_GATE = gate("Q16", "p_brand", "p_type", "p_size")
query("tpch_q16", with_(body=f"""SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt, {Q16_GATE} AS how
  {Q16} GROUP BY p_brand, p_type, p_size"""))(
    lambda t: result(q16(t).order_by(F.desc("supplier_cnt"), "p_brand", "p_type", "p_size"))
)
query("tpch_q16_tensor", with_(body=f"""SELECT {Q16_GATE} AS gate, {prod('pst', 'pt')} AS monomial,
  CAST(ps_suppkey AS VARCHAR) AS value, count(*) AS coef {Q16} GROUP BY ALL"""))(
    lambda t: q16(t).tensor("supplier_cnt")
)

# ---- Q17 small-quantity-order revenue ------------------------------------------


def q17(t: Tables) -> ProvFrame:
    f = t.lineitem.join(t.part.filter("p_brand = 'Brand#21' and p_size < 25"), [("l_partkey", "p_partkey")])
    f = scalar_compare(
        f,
        "l_quantity",
        "<",
        t.lineitem.prefixed("i_"),
        avg(money("i_l_quantity"), scale=0.2),
        "Q17A",
        [("p_partkey", "i_l_partkey")],
    )
    seventh = lambda v: v.cast("double") / 7.0
    return group(f, [], "Q17", {"avg_yearly": sum_(money("l_extendedprice"), scale=seventh)})


Q17 = f"""FROM l, p WHERE p_partkey = l_partkey AND p_brand = 'Brand#21' AND p_size < 25
  AND l_quantity < (SELECT 0.2 * {mean('b.l_quantity')} FROM l b WHERE b.l_partkey = p_partkey)"""
query("tpch_q17", with_(body=f"""SELECT CAST(sum({dec('l_extendedprice')}) AS DOUBLE) / CAST(7.0 AS DOUBLE) AS avg_yearly,
  'Q17[]' AS how {Q17}"""))(lambda t: result(q17(t)))
query(
    "tpch_q17_circuit",
    circuit_sql(
        ("'Q17[]'", prod("lt", "pt", gate("Q17A", "p_partkey")), Q17),
        (gate("Q17A", "l_partkey"), "lt", f"FROM l WHERE l_partkey IN (SELECT p_partkey {Q17})"),
    ),
)(lambda t: q17(t).circuit(reachable=True))

# ---- Q18 large volume customer -------------------------------------------------


def q18(t: Tables) -> ProvFrame:
    big = having(
        group(t.lineitem.prefixed("i_"), ["i_l_orderkey"], "Q18I", {"i_qty": sum_(money("i_l_quantity"))}),
        "i_qty",
        ">",
        214,
    )
    chosen = in_(t.orders, big, [("o_orderkey", "i_l_orderkey")], "Q18S")
    f = join_all([t.customer, chosen, t.lineitem], [("c_custkey", "o_custkey"), ("o_orderkey", "l_orderkey")])
    keys = ["c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice"]
    g = group(f, keys, "Q18", {"sum_qty": sum_(money("l_quantity"))})
    return g.order_by(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100)


Q18_BIG = f"SELECT l_orderkey FROM l GROUP BY l_orderkey HAVING sum({dec('l_quantity')}) > 214"
Q18 = f"""FROM c, o, l WHERE o_orderkey IN ({Q18_BIG}) AND c_custkey = o_custkey AND o_orderkey = l_orderkey"""
Q18_GATE = gate("Q18", "c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
Q18_TOP = f"""q18 AS (SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum({dec('l_quantity')}) AS sum_qty {Q18}
  GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice
  ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100)"""
query("tpch_q18", with_(Q18_TOP, body=f"""SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate,
  o_totalprice, CAST(sum_qty AS DOUBLE) AS sum_qty,
  'Q18[' || c_name || '|' || c_custkey || '|' || o_orderkey || '|' || q18.o_orderdate || '|' || o_totalprice || ']' AS how
  FROM q18"""))(lambda t: result(q18(t)))
query(
    "tpch_q18_circuit",
    circuit_sql(
        (Q18_GATE, prod("ct", "ot", "lt", gate("Q18S", "o_orderkey")), f"{Q18} AND o_orderkey IN (SELECT o_orderkey FROM q18)"),
        (gate("Q18S", "o_orderkey"), gate("Q18I", "o_orderkey"), "FROM q18"),
        (gate("Q18I", "l_orderkey"), "lt", "FROM l WHERE l_orderkey IN (SELECT o_orderkey FROM q18)"),
        ctes=(Q18_TOP,),
    ),
)(lambda t: q18(t).circuit(reachable=True))

# ---- Q19 discounted revenue ----------------------------------------------------

Q19_WHERE = """(p_brand = 'Brand#5' and l_quantity >= 7 and l_quantity <= 17 and p_size between 1 and 15)
  or (p_brand = 'Brand#15' and l_quantity >= 17 and l_quantity <= 27 and p_size between 1 and 30)
  or (p_brand = 'Brand#23' and l_quantity >= 20 and l_quantity <= 30 and p_size between 1 and 45)"""


def q19(t: Tables) -> ProvFrame:
    f = t.lineitem.join(t.part, [("l_partkey", "p_partkey")], where=F.expr(Q19_WHERE))
    return group(f, [], "Q19", {"revenue": sum_(volume())})


Q19 = f"FROM l, p WHERE p_partkey = l_partkey AND ({Q19_WHERE})"
query("tpch_q19", with_(body=f"SELECT CAST(sum({VOLUME}) AS DOUBLE) AS revenue, 'Q19[]' AS how {Q19}"))(
    lambda t: result(q19(t))
)
query("tpch_q19_circuit", circuit_sql(("'Q19[]'", prod("lt", "pt"), Q19)))(lambda t: q19(t).circuit())

# ---- Q20 potential part promotion ----------------------------------------------


def q20(t: Tables) -> ProvFrame:
    stock = in_(t.partsupp, t.part.filter("p_name like 'red%'"), [("ps_partkey", "p_partkey")], "Q20P")
    shipped = t.lineitem.filter("l_shipdate >= timestamp_ntz'1997-01-01' and l_shipdate < timestamp_ntz'1998-01-01'")
    stock = scalar_compare(
        stock,
        "ps_availqty",
        ">",
        shipped,
        sum_(money("l_quantity"), scale=0.5),
        "Q20L",
        [("ps_partkey", "l_partkey"), ("ps_suppkey", "l_suppkey")],
    )
    f = in_(t.supplier, stock, [("s_suppkey", "ps_suppkey")], "Q20S")
    f = f.join(t.nation.filter("n_name = 'NATION_3'"), [("s_nationkey", "n_nationkey")])
    return f.select("s_suppkey", "s_name")


Q20_STOCK = f"""q20 AS (SELECT * FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM p WHERE p_name LIKE 'red%')
  AND CAST(ps_availqty AS DOUBLE) > (SELECT 0.5 * CAST(sum({dec('l_quantity')}) AS DOUBLE) FROM l WHERE l_partkey = ps_partkey
  AND l_suppkey = ps_suppkey AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'))"""
Q20 = """FROM s, n WHERE s_suppkey IN (SELECT ps_suppkey FROM q20) AND s_nationkey = n_nationkey AND n_name = 'NATION_3'"""
query("tpch_q20", with_(Q20_STOCK, body=f"""SELECT s_suppkey, s_name, {prod('st', 'nt', gate('Q20S', 's_suppkey'))} AS how
  {Q20}"""))(lambda t: result(q20(t).order_by("s_name", "s_suppkey")))
Q20_USED = f"FROM q20 WHERE ps_suppkey IN (SELECT s_suppkey {Q20})"
query(
    "tpch_q20_circuit",
    circuit_sql(
        (
            gate("Q20S", "ps_suppkey"),
            prod("pst", gate("Q20P", "ps_partkey"), gate("Q20L", "ps_partkey", "ps_suppkey")),
            Q20_USED,
        ),
        (gate("Q20P", "p_partkey"), "pt", f"FROM p WHERE p_name LIKE 'red%' AND p_partkey IN (SELECT ps_partkey {Q20_USED})"),
        (
            gate("Q20L", "l_partkey", "l_suppkey"),
            "lt",
            f"""FROM l WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
            AND (l_partkey, l_suppkey) IN (SELECT (ps_partkey, ps_suppkey) {Q20_USED})""",
        ),
        ctes=(Q20_STOCK,),
    ),
)(lambda t: q20(t).circuit(reachable=True))

# ---- Q21 suppliers who kept orders waiting --------------------------------------


def q21(t: Tables) -> ProvFrame:
    late = t.lineitem.filter("l_returnflag = 'R'")
    f = join_all(
        [t.supplier, late, t.orders.filter("o_orderstatus = 'F'"), t.nation.filter("n_name = 'NATION_4'")],
        [("s_suppkey", "l_suppkey"), ("o_orderkey", "l_orderkey"), ("s_nationkey", "n_nationkey")],
    )
    f = anti_join(f, late.prefixed("i_"), [("l_orderkey", "i_l_orderkey")], ("l_suppkey", "<>", "i_l_suppkey"))
    f = semi_join(
        f, t.lineitem.prefixed("i_"), [("l_orderkey", "i_l_orderkey")], "Q21E", ("l_suppkey", "<>", "i_l_suppkey")
    )
    return group(f, ["s_name"], "Q21", {"numwait": count()})


Q21 = """FROM s, l, o, n WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND o_orderstatus = 'F'
  AND l_returnflag = 'R' AND s_nationkey = n_nationkey AND n_name = 'NATION_4'
  AND EXISTS (SELECT * FROM l l2 WHERE l2.l_orderkey = l.l_orderkey AND l2.l_suppkey <> l.l_suppkey)
  AND NOT EXISTS (SELECT * FROM l l3 WHERE l3.l_orderkey = l.l_orderkey AND l3.l_suppkey <> l.l_suppkey
    AND l3.l_returnflag = 'R')"""
query("tpch_q21", with_(body=f"""SELECT s_name, count(*) AS numwait, {gate('Q21', 's_name')} AS how {Q21} GROUP BY s_name
  ORDER BY count(*) DESC, s_name LIMIT 100"""))(
    lambda t: result(q21(t).order_by(F.desc("numwait"), "s_name").limit(100))
)
Q21_RANGE, Q21_GATES = range_gates_sql(
    "Q21E",
    f"SELECT {gate('Q21E', 'l_orderkey', 'l_suppkey')} AS gate, l_suppkey AS x, l_orderkey AS k0 {Q21}",
    "SELECT l_suppkey AS y, lt AS monomial, l_orderkey AS k0 FROM l",
    "<>",
    1,
)
Q21_TOP = f"""SELECT {gate('Q21', 's_name')} AS gate,
  {prod('st', 'l.lt', 'ot', 'nt', gate('Q21E', 'l.l_orderkey', 'l.l_suppkey'))} AS monomial {Q21}"""
query("tpch_q21_circuit", with_(Q21_RANGE, body=count_terms(Q21_TOP, *Q21_GATES)))(lambda t: q21(t).circuit())

# ---- Q22 global sales opportunity ----------------------------------------------


def q22(t: Tables) -> ProvFrame:
    codes = t.customer.filter(F.substring(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), 1, 2).isin(
        "02", "04", "06", "08", "10", "15", "21"))
    rich = codes.filter("c_acctbal > 0").prefixed("i_")
    f = scalar_compare(codes, "c_acctbal", ">", rich, avg(money("i_c_acctbal")), "Q22A")
    year = t.orders.filter("o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1996-04-01'")
    f = anti_join(f, year, [("c_custkey", "o_custkey")])
    f = f.with_columns(cntrycode=F.substring(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), 1, 2))
    return group(f, ["cntrycode"], "Q22", {"numcust": count(), "totacctbal": sum_(money("c_acctbal"))})


Q22 = f"""FROM (SELECT *, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS cntrycode FROM c) c
  WHERE cntrycode IN ('02', '04', '06', '08', '10', '15', '21')"""
Q22_ALL = f"""{Q22} AND c_acctbal > (SELECT {mean('c_acctbal')} {Q22} AND c_acctbal > 0)
  AND NOT EXISTS (SELECT * FROM o WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1996-01-01'
  AND o_orderdate < TIMESTAMP '1996-04-01')"""
query("tpch_q22", with_(body=f"""SELECT cntrycode, count(*) AS numcust, CAST(sum({dec('c_acctbal')}) AS DOUBLE) AS totacctbal,
  {gate('Q22', 'cntrycode')} AS how {Q22_ALL} GROUP BY cntrycode"""))(lambda t: result(q22(t).order_by("cntrycode")))
query(
    "tpch_q22_circuit",
    circuit_sql(
        (gate("Q22", "cntrycode"), prod("ct", "'Q22A[]'"), Q22_ALL), ("'Q22A[]'", "ct", f"{Q22} AND c_acctbal > 0")
    ),
)(lambda t: q22(t).circuit())
