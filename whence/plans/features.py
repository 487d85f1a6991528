"""One query per operator, on whole tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whence.functions.aggregates import avg, count, count_distinct, derivations, max_, min_, sum_
from whence.operators import evaluate as ev
from whence.operators import validate as val
from whence.operators.frame import ProvFrame, join_all
from whence.operators.grouping import distinct, group, having, self_join, union
from whence.operators.semirings import Polynomials, expand, forms
from whence.operators.subquery import (
    all_compare,
    anti_join,
    any_compare,
    having_subquery,
    in_,
    not_in,
    scalar_compare,
    semi_join,
)
from whence.plans import tpch
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
from whence.sources.store import store_table
from whence.sources.tokens import annotate_keys, annotate_ordinal, read_annotated


def terms(poly: Polynomials, kind: str = "how") -> DataFrame:
    """``(out, monomial, coef)``."""
    df = getattr(poly, kind)()
    cols = [F.col("c").alias("coef")] if "c" in df.columns else []
    text = F.col("text") if "text" in df.columns else F.array_join("m", " . ")
    return df.select("out", text.alias("monomial"), *cols)


def derivations_of(frame: ProvFrame, name: str, by: Column | None = None) -> DataFrame:
    """A gate's derivations with the tree nodes below it inlined: ``(gate, monomial, coef)``; added up ``by`` a value made of ``out``."""
    return terms(expand(frame, name, spread=by is None, text=True, by=by)).withColumnRenamed("out", "gate")


def texts_sql(form: str, source: str, delta: bool = False) -> str:
    """SQL of ``Polynomials.texts`` over a query of (out, term, coef)."""
    return f"SELECT out, '{form}' AS form, term, CAST(coef AS BIGINT) AS coef, {str(delta).lower()} AS delta FROM ({source})"


# ---- flagship ------------------------------------------------------------------


def flagship(t: Tables) -> ProvFrame:
    f = join_all(
        [t.lineitem.filter("l_quantity < 5"), t.supplier, t.nation],
        [("l_suppkey", "s_suppkey"), ("s_nationkey", "n_nationkey")],
    )
    return group(f, ["n_name"], "F")


SMALL = "FROM l JOIN s ON l_suppkey = s_suppkey JOIN n ON s_nationkey = n_nationkey WHERE l_quantity < 5"
query(
    "flagship",
    with_(
        body=f"""SELECT n_name, 'how' AS form, {prod('lt', 'st', 'nt')} AS term, CAST(1 AS BIGINT) AS coef,
        false AS delta {SMALL}""",
    ),
)(lambda t: forms(flagship(t), ["how"]))

# ---- tokens, result columns, store ------------------------------------------------

query("annotate_keys", with_(body="SELECT c_custkey, c_name, ct AS how FROM c"))(
    lambda t: result(t.customer.select("c_custkey", "c_name"))
)
query("annotate_compound_key", with_(body="SELECT ps_partkey, ps_suppkey, pst AS how FROM ps"))(
    lambda t: result(t.partsupp.select("ps_partkey", "ps_suppkey"))
)
query("annotate_ordinal", with_(body="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lt AS how FROM l"))(
    lambda t: result(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
)
query(
    "annotate_qualified",
    with_(body="SELECT o_orderkey, 'sales:orders:' || ot AS how FROM o"),
)(lambda t: result(annotate_keys(t.read("orders"), "O", ["o_orderkey"], qualified="sales:orders").select("o_orderkey")))
query(
    "annotate_qualified_ordinal",
    with_(body="SELECT l_orderkey, 'sales:lineitem:' || lt AS how FROM l"),
)(lambda t: result(annotate_ordinal(t.read("lineitem"), "L", qualified="sales:lineitem").select("l_orderkey")))
query("read_annotated", with_(body="SELECT s_suppkey, 'sup' || s_suppkey AS how FROM s"))(
    lambda t: result(
        read_annotated(
            t.read("supplier").withColumn("annotation", F.concat(F.lit("sup"), F.col("s_suppkey").cast("string"))),
            "annotation",
        ).select("s_suppkey")
    )
)
query("plain_run", with_(body=f"SELECT n_name, CAST(sum({VOLUME}) AS DOUBLE) AS revenue {tpch.Q5} GROUP BY n_name"))(
    lambda t: tpch.q5(t).plain().withColumn("revenue", F.col("revenue").cast("double"))
)

# A polynomial with coefficients, exponents and absorption: per nation, customers with
# their orders, rich customers alone, and rich customers joined with themselves.


def rich_mix(t: Tables) -> ProvFrame:
    with_orders = t.customer.join(t.orders, [("c_custkey", "o_custkey")]).select("c_nationkey")
    rich = t.customer.filter("c_acctbal > 5000")
    squared = rich.join(rich.prefixed("b_"), [("c_custkey", "b_c_custkey")]).select("c_nationkey")
    both = with_orders.union_all(rich.select("c_nationkey")).union_all(squared)
    return distinct(both, "MIX")


MIX = f"""mix AS (SELECT c_nationkey, [ct, ot] AS m FROM c JOIN o ON c_custkey = o_custkey
  UNION ALL SELECT c_nationkey, [ct] FROM c WHERE c_acctbal > 5000
  UNION ALL SELECT c_nationkey, [ct, ct] FROM c WHERE c_acctbal > 5000)"""
MIXED = (
    MIX,
    f"mp AS (SELECT {gate('MIX', 'c_nationkey')} AS out, list_sort(m) AS m, count(*) AS c FROM mix GROUP BY ALL)",
    "mw AS (SELECT DISTINCT out, list_sort(list_distinct(m)) AS m FROM mp)",
    """mb AS (SELECT * FROM mw a WHERE NOT EXISTS (SELECT * FROM mw b WHERE a.out = b.out AND len(b.m) < len(a.m)
         AND list_has_all(a.m, b.m)))""",
)
JOINED = "array_to_string(m, ' . ')"

query("form_how", with_(*MIXED, body=f"SELECT out, {JOINED} AS monomial, c AS coef FROM mp"))(
    lambda t: terms(expand(rich_mix(t)))
)
query("form_boolean", with_(*MIXED, body=f"SELECT out, {JOINED} AS monomial, CAST(1 AS BIGINT) AS coef FROM mp"))(
    lambda t: terms(expand(rich_mix(t)), "boolean")
)
query(
    "form_trio",
    with_(*MIXED, body="""SELECT out, array_to_string(list_sort(list_distinct(m)), ' . ') AS monomial,
    CAST(sum(c) AS BIGINT) AS coef FROM mp GROUP BY ALL"""),
)(lambda t: terms(expand(rich_mix(t)), "trio"))
query("form_why", with_(*MIXED, body=f"SELECT out, {JOINED} AS monomial FROM mw"))(
    lambda t: terms(expand(rich_mix(t)), "why")
)
query("form_posbool", with_(*MIXED, body=f"SELECT out, {JOINED} AS monomial FROM mb"))(
    lambda t: terms(expand(rich_mix(t)), "posbool")
)


def shared_token(t: Tables) -> ProvFrame:
    """Per nation, its suppliers and their lines: every witness holds the nation, and a rich supplier absorbs its lines."""
    places = t.nation.join(t.supplier, [("n_nationkey", "s_nationkey")])
    lines = places.join(t.lineitem, [("s_suppkey", "l_suppkey")])
    return distinct(lines.select("n_name").union_all(places.filter("s_acctbal > 5000").select("n_name")), "WIDE")


query(
    "form_posbool_wide",
    with_(body=f"""SELECT {gate('WIDE', 'n_name')} AS out, array_to_string(list_sort([nt, st, lt]), ' . ') AS monomial
    FROM n JOIN s ON n_nationkey = s_nationkey JOIN l ON l_suppkey = s_suppkey WHERE NOT s_acctbal > 5000
    UNION ALL SELECT {gate('WIDE', 'n_name')}, array_to_string(list_sort([nt, st]), ' . ')
    FROM n JOIN s ON n_nationkey = s_nationkey WHERE s_acctbal > 5000"""),
)(lambda t: terms(expand(shared_token(t)), "posbool"))
query("form_lineage", with_(*MIXED, body="SELECT DISTINCT out, unnest(m) AS token FROM mp"))(
    lambda t: expand(rich_mix(t)).lineage()
)
_TEXTS = {
    "how": f"SELECT out, {JOINED} AS term, c AS coef FROM mp",
    "boolean": f"SELECT out, {JOINED} AS term, 1 AS coef FROM mp",
    "trio": """SELECT out, array_to_string(list_sort(list_distinct(m)), ' . ') AS term, sum(c) AS coef FROM mp
        GROUP BY ALL""",
    "why": "SELECT out, '{' || array_to_string(m, ',') || '}' AS term, 1 AS coef FROM mw",
    "posbool": """SELECT out, CASE WHEN len(m) > 1 THEN '(' || array_to_string(m, ' ∧ ') || ')' ELSE m[1] END AS term,
        1 AS coef FROM mb""",
    "lineage": "SELECT DISTINCT out, unnest(m) AS term, 1 AS coef FROM mp",
}


def _texts(kind: str) -> None:
    query(f"cells_{kind}", with_(*MIXED, body=texts_sql(kind, _TEXTS[kind])))(lambda t: expand(rich_mix(t)).texts(kind))


for _kind in _TEXTS:
    _texts(_kind)

query(
    "result_columns",
    with_(
        *MIXED,
        body=f"""SELECT c_nationkey, form, term, coef, delta FROM
        ({' UNION ALL '.join(texts_sql(k, s) for k, s in _TEXTS.items())})
        JOIN (SELECT DISTINCT c_nationkey FROM mix) ON out = {gate('MIX', 'c_nationkey')}""",
    ),
)(lambda t: forms(rich_mix(t), list(_TEXTS)))
query(
    "provenance_store",
    with_(*MIXED, body=f"""SELECT out, md5(out || '~' || {JOINED}) AS derivation, c AS coef, token, count(*) AS exp
    FROM (SELECT *, unnest(m) AS token FROM mp) GROUP BY ALL"""),
)(lambda t: store_table(expand(rich_mix(t))))

# ---- projection, filter, result modes -----------------------------------------------

query("project", with_(body="SELECT l_orderkey, l_quantity * 2 AS twice, lt AS how FROM l"))(
    lambda t: result(t.lineitem.select("l_orderkey", (F.col("l_quantity") * 2).alias("twice")))
)
FILTER = """(l_quantity >= 10 and l_quantity < 20 or l_returnflag in ('R', 'N')) and l_linestatus like 'O%'
  and l_tax between 0.02 and 0.04 and l_partkey is not null and not l_suppkey is null and l_discount <> 0.05"""
query("filter", with_(body=f"SELECT l_orderkey, l_partkey, lt AS how FROM l WHERE {FILTER}"))(
    lambda t: result(t.lineitem.filter(FILTER).select("l_orderkey", "l_partkey"))
)
query(
    "project_derived",
    with_(body="""SELECT k, half, how FROM (SELECT o_orderkey AS k, o_totalprice / 2 AS half, ot AS how FROM o
    WHERE o_orderstatus = 'F') WHERE half > 100000"""),
)(
    lambda t: result(
        t.orders.filter("o_orderstatus = 'F'")
        .select("o_orderkey", F.col("o_totalprice") / 2)
        .to_columns("k", "half")
        .filter("half > 100000")
    )
)


def by_customer(t: Tables, mode: str = "resolved") -> ProvFrame:
    return group(t.orders, ["o_custkey"], "BC", {"total": sum_(money("o_totalprice")), "n": count()}, mode=mode)


BC = "FROM o GROUP BY o_custkey"
BC_GATE = gate("BC", "o_custkey")
query(
    "group_resolved_refs",
    with_(body=f"""SELECT o_custkey, CAST(sum({dec('o_totalprice')}) AS DOUBLE) AS total, count(*) AS n, {BC_GATE} AS how,
    {BC_GATE} || '.total' AS total_agg, {BC_GATE} || '.n' AS n_agg {BC}"""),
)(lambda t: result(by_customer(t).tensor_refs()))
query(
    "group_symbolic",
    with_(body=f"SELECT o_custkey, {BC_GATE} || '.total' AS total, {BC_GATE} || '.n' AS n, {BC_GATE} AS how {BC}"),
)(lambda t: result(by_customer(t, "symbolic")))
query(
    "filter_aggregate_symbolic",
    with_(body=f"""SELECT o_custkey, {BC_GATE} || '.total' AS total, {BC_GATE} || '.n' AS n,
    {BC_GATE} || ' . [' || {BC_GATE} || '.n > 1⊗12.0000]' AS how {BC}"""),
)(lambda t: result(having(by_customer(t, "symbolic"), "n", ">", 12, "symbolic")))
query(
    "filter_aggregate_resolved",
    with_(body=f"""SELECT o_custkey, CAST(sum({dec('o_totalprice')}) AS DOUBLE) AS total, count(*) AS n, {BC_GATE} AS how {BC}
    HAVING count(*) > 12"""),
)(lambda t: result(having(by_customer(t), "n", ">", 12)))
query(
    "aggregate_pass_through",
    with_(body=f"""SELECT c_name, n AS orders, {prod('ct', BC_GATE)} AS how, {BC_GATE} || '.n' AS orders_agg
    FROM c JOIN (SELECT o_custkey, count(*) AS n {BC}) ON c_custkey = o_custkey"""),
)(
    lambda t: result(
        t.customer.join(by_customer(t), [("c_custkey", "o_custkey")])
        .select("c_name", "n")
        .rename({"n": "orders"})
        .tensor_refs()
    )
)

# ---- joins ---------------------------------------------------------------------------

query(
    "join_inner",
    with_(body=f"SELECT c_custkey, o_orderkey, {prod('ct', 'ot')} AS how FROM c JOIN o ON c_custkey = o_custkey"),
)(lambda t: result(t.customer.join(t.orders, [("c_custkey", "o_custkey")]).select("c_custkey", "o_orderkey")))
query(
    "join_theta",
    with_(body=f"""SELECT c_custkey, r_name, {prod('ct', 'rt')} AS how FROM c JOIN r ON c_nationkey < r_regionkey * 6
    AND c_nationkey <> r_regionkey"""),
)(
    lambda t: result(
        t.customer.theta_join(
            t.region, F.expr("c_nationkey < r_regionkey * 6 and c_nationkey <> r_regionkey")
        ).select("c_custkey", "r_name")
    )
)
query(
    "join_like",
    with_(body=f"SELECT c_custkey, n_name, {prod('ct', 'nt')} AS how FROM c JOIN n ON c_name LIKE '%' || n_nationkey"),
)(
    lambda t: result(
        t.customer.theta_join(t.nation, F.expr("c_name like concat('%', n_nationkey)")).select("c_custkey", "n_name")
    )
)
query(
    "join_band",
    with_(body=f"""SELECT s_suppkey, c_custkey, {prod('st', 'ct')} AS how FROM s JOIN c
    ON s_acctbal BETWEEN c_acctbal - 1 AND c_acctbal + 1"""),
)(
    lambda t: result(
        t.supplier.band_join(
            t.customer.with_columns(low=F.col("c_acctbal") - 1, high=F.col("c_acctbal") + 1),
            "s_acctbal", "low", "high", 5,
        ).select("s_suppkey", "c_custkey")
    )
)
COMMA = """c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_nationkey = n_nationkey AND n_name < 'NATION_2'
  AND l_quantity > 45"""
query(
    "join_comma_list",
    with_(body=f"SELECT c_name, n_name, l_quantity, {prod('ct', 'ot', 'lt', 'nt')} AS how FROM c, o, l, n WHERE {COMMA}"),
)(
    lambda t: result(
        join_all(
            [t.customer, t.orders, t.lineitem, t.nation],
            [("c_custkey", "o_custkey"), ("l_orderkey", "o_orderkey"), ("c_nationkey", "n_nationkey")],
            F.expr("n_name < 'NATION_2' and l_quantity > 45"),
        ).select("c_name", "n_name", "l_quantity")
    )
)
LATE = "o_orderdate >= TIMESTAMP '2000-06-01'"


def late_orders(t: Tables) -> ProvFrame:
    return t.orders.filter("o_orderdate >= timestamp_ntz'2000-06-01'")


query(
    "join_left",
    with_(body=f"""SELECT c_custkey, o_orderkey, CASE WHEN ot IS NULL THEN ct ELSE {prod('ct', 'ot')} END AS how
    FROM c LEFT JOIN o ON c_custkey = o_custkey AND {LATE}"""),
)(lambda t: result(t.customer.join(late_orders(t), [("c_custkey", "o_custkey")], "left").select("c_custkey", "o_orderkey")))
query(
    "join_right",
    with_(body=f"""SELECT c_custkey, o_orderkey, CASE WHEN ot IS NULL THEN ct ELSE {prod('ct', 'ot')} END AS how
    FROM (SELECT * FROM o WHERE {LATE}) RIGHT JOIN c ON c_custkey = o_custkey"""),
)(lambda t: result(late_orders(t).join(t.customer, [("o_custkey", "c_custkey")], "right").select("c_custkey", "o_orderkey")))
query("join_cross", with_(body=f"SELECT c_custkey, r_name, {prod('ct', 'rt')} AS how FROM c CROSS JOIN r"))(
    lambda t: result(t.customer.cross_join(t.region).select("c_custkey", "r_name"))
)


def same_line(t: Tables) -> ProvFrame:
    return self_join(t.lineitem, ["l_orderkey", "l_linenumber"], "SELF")


SELF = gate("SELF", "l_orderkey", "l_linenumber")
query(
    "join_self",
    with_(body=f"""SELECT l_orderkey, l_linenumber, count(*) AS members, count(*) * count(*) AS pairs, {prod(SELF, SELF)} AS how
    FROM l GROUP BY l_orderkey, l_linenumber"""),
)(lambda t: result(same_line(t)))
query("join_self_circuit", circuit_sql((SELF, "lt", "FROM l")))(lambda t: same_line(t).circuit())
query(
    "join_self_aliases",
    with_(body=f"""SELECT a.c_custkey AS c_custkey, b.c_name AS other_name, {prod('a.ct', 'b.ct')} AS how FROM c a JOIN c b
    ON a.c_custkey = b.c_custkey"""),
)(
    lambda t: result(
        t.customer.join(t.customer.prefixed("b_"), [("c_custkey", "b_c_custkey")])
        .rename({"b_c_name": "other_name"})
        .select("c_custkey", "other_name")
    )
)


def heavy_orders(t: Tables) -> ProvFrame:
    lines = group(t.lineitem, ["l_orderkey"], "HO", {"qty": sum_(money("l_quantity"))})
    return t.orders.filter("o_orderpriority = '1-URGENT'").join(lines, [("o_orderkey", "l_orderkey")])


HO = "FROM o JOIN l ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'"
query(
    "join_derived",
    with_(body=f"""SELECT o_orderkey, CAST(sum({dec('l_quantity')}) AS DOUBLE) AS qty,
    {prod('any_value(ot)', gate('HO', 'o_orderkey'))} AS how {HO} GROUP BY o_orderkey"""),
)(lambda t: result(heavy_orders(t).select("o_orderkey", "qty")))
query(
    "join_derived_expanded",
    with_(body=f"""SELECT {prod('ot', gate('HO', 'o_orderkey'))} AS out, {prod('ot', 'lt')} AS monomial, count(*) AS coef {HO}
    GROUP BY ALL"""),
)(lambda t: terms(expand(heavy_orders(t))))


def best_orders(t: Tables, mode: str) -> ProvFrame:
    """Orders joined with their customer's highest total, which is an aggregate column."""
    return scalar_compare(
        t.orders, "o_totalprice", "=", t.orders.prefixed("i_"), max_("i_o_totalprice"), "BO", [("o_custkey", "i_o_custkey")],
        mode=mode,
    )


BO = gate("BO", "o_custkey")
query(
    "join_aggregate_resolved",
    with_(body=f"""SELECT o_custkey, o_orderkey, {prod('ot', BO)} AS how FROM o
    JOIN (SELECT o_custkey AS k, max(o_totalprice) AS top FROM o GROUP BY o_custkey) ON k = o_custkey AND top = o_totalprice"""),
)(lambda t: result(best_orders(t, "resolved").select("o_custkey", "o_orderkey")))
query(
    "join_aggregate_symbolic",
    with_(body=f"""SELECT o_custkey, o_orderkey, {prod('ot', BO)} || ' . [' || {BO} || '.v = 1⊗'
    || CAST(CAST(o_totalprice AS DECIMAL(28,4)) AS VARCHAR) || ']' AS how FROM o"""),
)(lambda t: result(best_orders(t, "symbolic").select("o_custkey", "o_orderkey")))
query(
    "resolve_conditions",
    with_(body=f"""SELECT o_custkey, o_orderkey, {prod('ot', BO)} AS how FROM o
    JOIN (SELECT o_custkey AS k, max(o_totalprice) AS top FROM o GROUP BY o_custkey) ON k = o_custkey AND top = o_totalprice"""),
)(lambda t: result(ev.resolve(best_orders(t, "symbolic")).select("o_custkey", "o_orderkey")))

# ---- subqueries ------------------------------------------------------------------------

LINES = [("o_orderkey", "l_orderkey")]


def returned(t: Tables) -> ProvFrame:
    return t.lineitem.filter("l_returnflag = 'R'")


def with_returns(t: Tables) -> ProvFrame:
    return semi_join(t.orders, returned(t), LINES, "EX").select("o_orderkey", "o_custkey")


EX = gate("EX", "o_orderkey")
query(
    "exists",
    with_(body=f"""SELECT o_orderkey, o_custkey, {prod('ot', EX)} AS how FROM o
    WHERE EXISTS (SELECT * FROM l WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"""),
)(lambda t: result(with_returns(t)))
query(
    "exists_expanded",
    with_(body=f"""SELECT {prod('ot', EX)} AS out, {prod('ot', 'lt')} AS monomial, count(*) AS coef
    FROM o JOIN l ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY ALL"""),
)(lambda t: terms(expand(with_returns(t))))
query(
    "exists_residual",
    with_(body=f"""SELECT l_orderkey, l_linenumber, {prod('lt', gate('EXR', 'l_orderkey', 'l_suppkey'))} AS how FROM l
    WHERE EXISTS (SELECT * FROM l b WHERE b.l_orderkey = l.l_orderkey AND b.l_suppkey > l.l_suppkey)"""),
)(
    lambda t: result(
        semi_join(
            t.lineitem, t.lineitem.prefixed("i_"), [("l_orderkey", "i_l_orderkey")], "EXR",
            ("l_suppkey", "<", "i_l_suppkey"),
        ).select("l_orderkey", "l_linenumber")
    )
)
query(
    "not_exists",
    with_(body=f"""SELECT o_orderkey, ot AS how FROM o
    WHERE NOT EXISTS (SELECT * FROM l WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"""),
)(lambda t: result(anti_join(t.orders, returned(t), LINES).select("o_orderkey")))
query(
    "not_exists_residual",
    with_(body="""SELECT l_orderkey, l_linenumber, lt AS how FROM l
    WHERE NOT EXISTS (SELECT * FROM l b WHERE b.l_orderkey = l.l_orderkey AND b.l_quantity >= l.l_quantity AND b.l_returnflag = 'R')"""),
)(
    lambda t: result(
        anti_join(
            t.lineitem, returned(t).prefixed("i_"), [("l_orderkey", "i_l_orderkey")],
            ("l_quantity", "<=", "i_l_quantity"),
        ).select("l_orderkey", "l_linenumber")
    )
)
query(
    "in_columns",
    with_(body=f"""SELECT ps_partkey, ps_suppkey, {prod('pst', gate('IN2', 'ps_partkey', 'ps_suppkey'))} AS how FROM ps
    WHERE (ps_partkey, ps_suppkey) IN (SELECT (l_partkey, l_suppkey) FROM l WHERE l_quantity > 40)"""),
)(
    lambda t: result(
        in_(
            t.partsupp, t.lineitem.filter("l_quantity > 40"),
            [("ps_partkey", "l_partkey"), ("ps_suppkey", "l_suppkey")], "IN2",
        ).select("ps_partkey", "ps_suppkey")
    )
)
query(
    "in_correlated",
    with_(body=f"""SELECT s_suppkey, {prod('st', gate('INC', 's_nationkey', 's_suppkey'))} AS how FROM s
    WHERE s_nationkey IN (SELECT c_nationkey FROM c JOIN o ON c_custkey = o_custkey JOIN l ON l_orderkey = o_orderkey
      WHERE l_suppkey = s_suppkey)"""),
)(
    lambda t: result(
        in_(
            t.supplier,
            join_all([t.customer, t.orders, t.lineitem], [("c_custkey", "o_custkey"), ("o_orderkey", "l_orderkey")]),
            [("s_nationkey", "c_nationkey")], "INC", [("s_suppkey", "l_suppkey")],
        ).select("s_suppkey")
    )
)
query(
    "not_in",
    with_(body=f"""SELECT c_custkey, ct AS how FROM c WHERE c_custkey NOT IN (SELECT o_custkey FROM o WHERE {LATE})"""),
)(lambda t: result(not_in(t.customer, late_orders(t), "c_custkey", "o_custkey").select("c_custkey")))
query(
    "not_in_correlated",
    with_(body="""SELECT o_orderkey, ot AS how FROM o WHERE o_totalprice NOT IN
    (SELECT b.o_totalprice FROM o b WHERE b.o_custkey = o.o_custkey AND b.o_orderstatus = 'F')"""),
)(
    lambda t: result(
        not_in(
            t.orders, t.orders.filter("o_orderstatus = 'F'").prefixed("i_"), "o_totalprice", "i_o_totalprice",
            [("o_custkey", "i_o_custkey")],
        ).select("o_orderkey")
    )
)

_SCALAR = {"eq": ("=", "max"), "gt": (">", "avg"), "ge": (">=", "avg"), "lt": ("<", "avg"), "le": ("<=", "min"), "ne": ("<>", "min")}


def _scalar(tag: str) -> None:
    op, kind = _SCALAR[tag]
    agg = {"max": max_, "min": min_, "avg": avg}[kind]
    inner = mean("o_totalprice") if kind == "avg" else f"{kind}(o_totalprice)"
    fold = lambda: agg(money("i_o_totalprice") if kind == "avg" else "i_o_totalprice")
    name = f"SC{tag}"
    query(
        f"scalar_{tag}",
        with_(body=f"SELECT o_orderkey, {prod('ot', gate(name))} AS how FROM o WHERE o_totalprice {op} (SELECT {inner} FROM o)"),
    )(
        lambda t: result(
            scalar_compare(t.orders, "o_totalprice", op, t.orders.prefixed("i_"), fold(), name).select("o_orderkey")
        )
    )
    query(
        f"scalar_{tag}_correlated",
        with_(body=f"""SELECT o_orderkey, {prod('ot', gate(name, 'o_custkey'))} AS how FROM o
        WHERE o_totalprice {op} (SELECT {inner.replace('o_totalprice', 'b.o_totalprice')} FROM o b WHERE b.o_custkey = o.o_custkey)"""),
    )(
        lambda t: result(
            scalar_compare(
                t.orders, "o_totalprice", op, t.orders.prefixed("i_"), fold(), name, [("o_custkey", "i_o_custkey")]
            ).select("o_orderkey")
        )
    )


for _tag in _SCALAR:
    _scalar(_tag)

query(
    "scalar_count_correlated",
    with_(body=f"""SELECT c_custkey, CASE WHEN n > 0 THEN {prod('ct', gate('SCC', 'c_custkey'))} ELSE ct END AS how
    FROM (SELECT c.*, (SELECT count(*) FROM o WHERE o_custkey = c_custkey AND {LATE}) AS n FROM c) WHERE 2 > n"""),
)(
    lambda t: result(
        scalar_compare(
            t.customer.with_columns(two=F.lit(2)), "two", ">", late_orders(t), count(), "SCC", [("c_custkey", "o_custkey")]
        ).select("c_custkey")
    )
)
query(
    "scalar_or",
    with_(body=f"""SELECT o_orderkey, CASE WHEN o_totalprice > a THEN {prod('ot', gate('SCO', 'o_custkey'))} ELSE ot END AS how
    FROM o JOIN (SELECT o_custkey AS k, {mean('o_totalprice')} AS a FROM o GROUP BY o_custkey) ON k = o_custkey
    WHERE o_totalprice > a OR o_orderpriority = '5-LOW'"""),
)(
    lambda t: result(
        scalar_compare(
            t.orders, "o_totalprice", ">", t.orders.prefixed("i_"), avg(money("i_o_totalprice")), "SCO",
            [("o_custkey", "i_o_custkey")], or_where=F.col("o_orderpriority") == "5-LOW",
        ).select("o_orderkey")
    )
)


def cheap_parts(t: Tables) -> ProvFrame:
    """Parts cheaper than some positive supplier balance."""
    parts = t.part.with_columns(price=money("p_retailprice"))
    balances = t.supplier.filter("s_acctbal > 0").with_columns(balance=money("s_acctbal"))
    return any_compare(parts, "price", "<", balances, "balance", "ANY")


CENTS = "CAST({c} * 100 AS BIGINT)"
ANY_RANGE, ANY_GATES = range_gates_sql(
    "ANY",
    f"""SELECT {gate('ANY', dec('p_retailprice'))} AS gate, {CENTS.format(c=dec('p_retailprice'))} AS x FROM p
    WHERE {dec('p_retailprice')} < (SELECT max({dec('s_acctbal')}) FROM s)""",
    f"SELECT {CENTS.format(c=dec('s_acctbal'))} AS y, st AS monomial FROM s WHERE s_acctbal > 0",
    "<",
    0,
)
query(
    "any_uncorrelated",
    with_(body=f"""SELECT p_partkey, {prod('pt', gate('ANY', dec('p_retailprice')))} AS how FROM p
    WHERE {dec('p_retailprice')} < ANY (SELECT {dec('s_acctbal')} FROM s WHERE s_acctbal > 0)"""),
)(lambda t: result(cheap_parts(t).select("p_partkey")))
query("any_uncorrelated_circuit", with_(ANY_RANGE, body=count_terms(*ANY_GATES)))(lambda t: cheap_parts(t).circuit())


def any_local(t: Tables) -> ProvFrame:
    """Customers at least as rich as some supplier of their nation."""
    return any_compare(
        t.customer.with_columns(bal=money("c_acctbal")),
        "bal",
        ">=",
        t.supplier.with_columns(sbal=money("s_acctbal")),
        "sbal",
        "ANYC",
        [("c_nationkey", "s_nationkey")],
    )


ANYC = gate("ANYC", "c_nationkey", dec("c_acctbal"))
query(
    "any_correlated",
    with_(body=f"""SELECT c_custkey, {prod('ct', ANYC)} AS how FROM c
    WHERE EXISTS (SELECT * FROM s WHERE s_nationkey = c_nationkey AND c_acctbal >= s_acctbal)"""),
)(lambda t: result(any_local(t).select("c_custkey")))
ANYR, ANYR_GATES = range_gates_sql(
    "LATER",
    f"""SELECT {gate('LATER', 'o_custkey', 'o_orderkey')} AS gate, o_orderkey AS x, o_custkey AS k0 FROM o
    WHERE o_orderkey < (SELECT max(b.o_orderkey) FROM o b WHERE b.o_custkey = o.o_custkey AND b.o_orderstatus = 'F')""",
    "SELECT o_orderkey AS y, ot AS monomial, o_custkey AS k0 FROM o WHERE o_orderstatus = 'F'",
    "<",
    1,
)


def followed(t: Tables) -> ProvFrame:
    """Orders with a later finished order of the same customer."""
    done = t.orders.filter("o_orderstatus = 'F'").prefixed("i_")
    return any_compare(t.orders, "o_orderkey", "<", done, "i_o_orderkey", "LATER", [("o_custkey", "i_o_custkey")])


query("any_correlated_circuit", with_(ANYR, body=count_terms(*ANYR_GATES)))(lambda t: followed(t).circuit())
_ALL = {
    "gt": (">", "c_acctbal > hi"), "ge": (">=", "c_acctbal >= hi"), "lt": ("<", "c_acctbal < lo"),
    "le": ("<=", "c_acctbal <= lo"), "eq": ("=", "c_acctbal = lo AND c_acctbal = hi"),
}


def _all(tag: str) -> None:
    op, test = _ALL[tag]
    name = f"ALL{tag}"
    few = "s_acctbal > 2000"
    query(
        f"all_{tag}",
        with_(body=f"""SELECT c_custkey, CASE WHEN k IS NULL THEN ct ELSE {prod('ct', gate(name, 'c_nationkey'))} END AS how
        FROM c LEFT JOIN (SELECT s_nationkey AS k, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM s WHERE {few}
          GROUP BY s_nationkey) ON k = c_nationkey WHERE k IS NULL OR ({test})"""),
    )(
        lambda t: result(
            all_compare(
                t.customer, "c_acctbal", op, t.supplier.filter(few), "s_acctbal", name, [("c_nationkey", "s_nationkey")]
            ).select("c_custkey")
        )
    )


for _tag in _ALL:
    _all(_tag)

query(
    "all_uncorrelated",
    with_(body=f"SELECT o_orderkey, {prod('ot', gate('ALLU'))} AS how FROM o WHERE o_totalprice > ALL (SELECT c_acctbal * 40 FROM c)"),
)(
    lambda t: result(
        all_compare(
            t.orders, "o_totalprice", ">", t.customer.with_columns(bal=F.col("c_acctbal") * 40), "bal", "ALLU"
        ).select("o_orderkey")
    )
)
query(
    "all_ne",
    with_(body="""SELECT c_custkey, ct AS how FROM c WHERE c_nationkey <> ALL (SELECT s_nationkey FROM s WHERE s_acctbal > 5000)"""),
)(
    lambda t: result(
        all_compare(t.customer, "c_nationkey", "<>", t.supplier.filter("s_acctbal > 5000"), "s_nationkey", "ALLN").select(
            "c_custkey"
        )
    )
)
query(
    "row_compare",
    with_(body=f"""SELECT c_custkey, {prod('ct', gate('ROW', 'c_nationkey', 'c_acctbal'))} AS how FROM c
    WHERE EXISTS (SELECT * FROM s WHERE c_nationkey > s_nationkey OR (c_nationkey = s_nationkey AND c_acctbal > s_acctbal))"""),
)(
    lambda t: result(
        any_compare(
            t.customer, ["c_nationkey", "c_acctbal"], ">", t.supplier, ["s_nationkey", "s_acctbal"], "ROW"
        ).select("c_custkey")
    )
)
query(
    "having_subquery_symbolic",
    with_(body=f"""SELECT ps_partkey, CAST(sum(ps_supplycost * ps_availqty) AS DOUBLE) AS value,
    {prod(gate('Q11', 'ps_partkey'), gate('Q11T'))} || ' . [' || {gate('Q11', 'ps_partkey')} || '.value > Q11T[].v]' AS how
    {tpch.Q11} GROUP BY ps_partkey"""),
)(lambda t: result(tpch.q11(t, "symbolic")))
query(
    "having_subquery_evaluated",
    with_(body=f"""SELECT ps_partkey, {tpch.Q11_SUM} AS value, {prod(gate('Q11', 'ps_partkey'), gate('Q11T'))} AS how {tpch.Q11}
    GROUP BY ps_partkey HAVING {tpch.Q11_SUM} > (SELECT {tpch.Q11_SUM} * 0.001 {tpch.Q11})"""),
)(lambda t: result(ev.resolve(tpch.q11(t, "symbolic"))))


def cte_twice(t: Tables) -> ProvFrame:
    per_supplier = group(t.lineitem, ["l_suppkey"], "CTE", {"qty": sum_(money("l_quantity"))})
    f = t.supplier.join(per_supplier, [("s_suppkey", "l_suppkey")])
    return scalar_compare(f, "qty", ">", per_supplier, avg("qty"), "CTEA").select("s_suppkey", "qty")


CTE = f"w AS (SELECT l_suppkey, sum({dec('l_quantity')}) AS qty FROM l GROUP BY l_suppkey)"
query(
    "common_table",
    with_(CTE, body=f"""SELECT s_suppkey, CAST(qty AS DOUBLE) AS qty, {prod('st', gate('CTE', 's_suppkey'), gate('CTEA'))} AS how
    FROM s JOIN w ON s_suppkey = l_suppkey WHERE CAST(qty AS DOUBLE) > (SELECT CAST(sum(qty) AS DOUBLE) / count(qty) FROM w)"""),
)(lambda t: result(cte_twice(t)))


def shared_key(t: Tables) -> ProvFrame:
    f = semi_join(t.orders, t.customer.filter("c_acctbal > 0"), [("o_custkey", "c_custkey")], "MUL")
    return f.count_over(["o_custkey"], "sharing").select("o_orderkey", "sharing")


query(
    "exists_multiplicity",
    with_(body=f"""SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS sharing, {prod('ot', gate('MUL', 'o_custkey'))} AS how
    FROM o WHERE EXISTS (SELECT * FROM c WHERE c_custkey = o_custkey AND c_acctbal > 0)"""),
)(lambda t: result(shared_key(t)))

# ---- aggregation -------------------------------------------------------------------------


def grouped_lines(t: Tables) -> ProvFrame:
    aggs = {
        "qty": sum_(money("l_quantity")),
        "lines": count(),
        "mean": avg(money("l_extendedprice")),
        "low": min_(money("l_extendedprice")),
        "high": max_(money("l_extendedprice")),
        "parts": count_distinct("l_partkey"),
        "cntprov": derivations(),
    }
    return group(t.lineitem, ["l_suppkey"], "GL", aggs)


GL = gate("GL", "l_suppkey")
GL_VALUES = f"""CAST(sum({dec('l_quantity')}) AS DOUBLE) AS qty, count(*) AS lines, {mean('l_extendedprice')} AS mean,
  CAST(min({dec('l_extendedprice')}) AS DOUBLE) AS low, CAST(max({dec('l_extendedprice')}) AS DOUBLE) AS high,
  count(DISTINCT l_partkey) AS parts"""
query("group_aggregates", with_(body=f"SELECT l_suppkey, {GL_VALUES}, count(*) AS cntprov, {GL} AS how FROM l GROUP BY l_suppkey"))(
    lambda t: result(grouped_lines(t))
)
_TENSOR = {
    "qty": f"CAST({dec('l_quantity')} AS VARCHAR)",
    "lines": "'1'",
    "mean": f"CAST({dec('l_extendedprice')} AS VARCHAR)",
    "low": f"CAST({dec('l_extendedprice')} AS VARCHAR)",
    "high": f"CAST({dec('l_extendedprice')} AS VARCHAR)",
    "parts": "CAST(l_partkey AS VARCHAR)",
}


def _tensor(alias: str) -> None:
    query(
        f"tensor_{alias}",
        with_(body=f"SELECT {GL} AS gate, lt AS monomial, {_TENSOR[alias]} AS value, count(*) AS coef FROM l GROUP BY ALL"),
    )(lambda t: grouped_lines(t).tensor(alias))


for _alias in _TENSOR:
    _tensor(_alias)

query(
    "distinct",
    with_(body=f"""SELECT DISTINCT p_brand, p_type, {gate('DI', 'p_brand', 'p_type')} AS how FROM p JOIN l ON l_partkey = p_partkey"""),
)(lambda t: result(distinct(t.part.join(t.lineitem, [("p_partkey", "l_partkey")]).select("p_brand", "p_type"), "DI")))
query(
    "group_global",
    with_(body=f"SELECT count(*) AS n, {mean('o_totalprice')} AS mean, max(o_totalprice) AS top, 'GG[]' AS how FROM o"),
)(lambda t: result(group(t.orders, [], "GG", {"n": count(), "mean": avg(money("o_totalprice")), "top": max_("o_totalprice")})))


def combined(t: Tables) -> ProvFrame:
    """Sum, difference and ratio of two aggregates; their tensors stay apart."""
    g = group(
        t.lineitem, ["l_returnflag"], "CO", {"gross": sum_(money("l_extendedprice")), "net": sum_(volume()), "n": count()}
    )
    gross, net = F.col("gross").cast("double"), F.col("net").cast("double")
    return g.with_columns(both=gross + net, saved=gross - net, share=net / gross)


_G, _N = f"CAST(sum({dec('l_extendedprice')}) AS DOUBLE)", f"CAST(sum({VOLUME}) AS DOUBLE)"
query(
    "aggregate_arithmetic",
    with_(body=f"""SELECT l_returnflag, {_G} AS gross, {_N} AS net, count(*) AS n, {_G} + {_N} AS both, {_G} - {_N} AS saved,
    {_N} / {_G} AS share, {gate('CO', 'l_returnflag')} AS how FROM l GROUP BY l_returnflag"""),
)(lambda t: result(combined(t)))
query(
    "aggregate_scaled",
    with_(body=f"""SELECT l_returnflag, CAST(100 * sum({dec('l_quantity')}) AS DOUBLE) AS hundred,
    {mean('l_quantity')} * 0.2 AS fifth, CAST(sum({dec('l_quantity')}) AS DOUBLE) / 7 AS week, {gate('AS', 'l_returnflag')} AS how
    FROM l GROUP BY l_returnflag"""),
)(
    lambda t: result(
        group(t.lineitem, ["l_returnflag"], "AS", {
            "hundred": sum_(money("l_quantity"), scale=100),
            "fifth": avg(money("l_quantity"), scale=0.2),
            "week": sum_(money("l_quantity"), scale=lambda v: v.cast("double") / 7),
        })
    )
)
_HAVING = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def _having(tag: str) -> None:
    op = _HAVING[tag]
    query(
        f"having_{tag}",
        with_(body=f"SELECT o_custkey, count(*) AS n, {gate('HV', 'o_custkey')} AS how FROM o GROUP BY o_custkey HAVING count(*) {op} 10"),
    )(lambda t: result(having(group(t.orders, ["o_custkey"], "HV", {"n": count()}), "n", op, 10)))


for _tag in _HAVING:
    _having(_tag)


def sums_of_sums(t: Tables) -> ProvFrame:
    per_order = group(t.lineitem, ["l_orderkey"], "SS1", {"qty": sum_(money("l_quantity"))})
    f = t.orders.join(per_order, [("o_orderkey", "l_orderkey")])
    return group(f, ["o_orderpriority"], "SS2", {"most": max_("qty"), "total": sum_("qty")})


SS = f"""FROM o JOIN (SELECT l_orderkey, sum({dec('l_quantity')}) AS qty FROM l GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""
query(
    "aggregate_of_aggregate",
    with_(body=f"""SELECT o_orderpriority, CAST(max(qty) AS DOUBLE) AS most, CAST(sum(qty) AS DOUBLE) AS total,
    {gate('SS2', 'o_orderpriority')} AS how {SS} GROUP BY o_orderpriority"""),
)(lambda t: result(sums_of_sums(t)))
query(
    "aggregate_of_aggregate_tensor",
    with_(body=f"""SELECT {gate('SS2', 'o_orderpriority')} AS gate, {prod('ot', gate('SS1', 'l_orderkey'))} AS monomial,
    CAST(CAST(qty AS DECIMAL(22,2)) AS VARCHAR) AS value, count(*) AS coef {SS} GROUP BY ALL"""),
)(lambda t: sums_of_sums(t).tensor("total"))
query(
    "aggregate_of_aggregate_expanded",
    with_(body=f"""SELECT {gate('SS2', 'o_orderpriority')} AS out, {prod('ot', 'lt')} AS monomial, count(*) AS coef
    FROM o JOIN l ON l_orderkey = o_orderkey GROUP BY ALL"""),
)(lambda t: terms(expand(sums_of_sums(t))))
query(
    "annotation_aggregate",
    with_(
        body=texts_sql(
            "how",
            f"""SELECT {gate('AA', 'o_custkey')} AS out, {prod('ot', 'ct')} AS term, 1 AS coef
            FROM o JOIN c ON c_custkey = o_custkey""",
            delta=True,
        )
    ),
)(
    lambda t: expand(
        group(t.orders.join(t.customer, [("o_custkey", "c_custkey")]), ["o_custkey"], "AA", {"n": count()})
    ).texts("how")
)

# ---- set operations ------------------------------------------------------------------------


def named(t: Tables) -> tuple[ProvFrame, ProvFrame]:
    c = t.customer.select(F.col("c_nationkey").alias("place"), (F.col("c_acctbal") > 0).alias("solvent"))
    s = t.supplier.select(F.col("s_nationkey").alias("place"), (F.col("s_acctbal") > 0).alias("solvent"))
    return c, s


NAMED = """(SELECT c_nationkey AS place, c_acctbal > 0 AS solvent, ct AS how FROM c
  UNION ALL SELECT s_nationkey, s_acctbal > 0, st FROM s)"""
query("union_all", with_(body=f"SELECT * FROM {NAMED}"))(lambda t: result(named(t)[0].union_all(named(t)[1])))
query("union", with_(body=f"SELECT DISTINCT place, solvent, {gate('UN', 'place', 'solvent')} AS how FROM {NAMED}"))(
    lambda t: result(union(named(t), "UN"))
)
query("union_circuit", circuit_sql((gate("UN", "place", "solvent"), "how", f"FROM {NAMED}")))(
    lambda t: union(named(t), "UN").circuit()
)


def two_counts(t: Tables) -> ProvFrame:
    a = group(t.customer, ["c_nationkey"], "UC", {"n": count(), "bal": sum_(money("c_acctbal"))}).to_columns("place", "n", "bal")
    b = group(t.supplier, ["s_nationkey"], "US", {"n": count(), "bal": sum_(money("s_acctbal"))}).to_columns("place", "n", "bal")
    return a.union_all(b)


query(
    "union_aggregates",
    with_(body=f"""SELECT c_nationkey AS place, count(*) AS n, CAST(sum({dec('c_acctbal')}) AS DOUBLE) AS bal,
    {gate('UC', 'c_nationkey')} AS how FROM c GROUP BY c_nationkey UNION ALL SELECT s_nationkey, count(*),
    CAST(sum({dec('s_acctbal')}) AS DOUBLE), {gate('US', 's_nationkey')} FROM s GROUP BY s_nationkey"""),
)(lambda t: result(two_counts(t)))
query(
    "union_aggregates_circuit",
    circuit_sql((gate("UC", "c_nationkey"), "ct", "FROM c"), (gate("US", "s_nationkey"), "st", "FROM s")),
)(lambda t: two_counts(t).circuit())
query(
    "union_missing_columns",
    with_(body="""SELECT c_custkey, c_mktsegment, CAST(NULL AS BIGINT) AS s_suppkey, ct AS how FROM c
    UNION ALL SELECT NULL, NULL, s_suppkey, st FROM s"""),
)(
    lambda t: result(
        t.customer.select("c_custkey", "c_mktsegment").union_all(t.supplier.select("s_suppkey"), allow_missing=True)
    )
)

# ---- order, top-k, windows, scalar expressions ------------------------------------------------

query(
    "top_k",
    with_(body="SELECT o_orderkey, o_totalprice, ot AS how FROM o ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"),
)(lambda t: result(t.orders.select("o_orderkey", "o_totalprice").order_by(F.desc("o_totalprice"), "o_orderkey").limit(100)))
query(
    "top_per_group",
    with_(body="""SELECT c_custkey, c_mktsegment, rank, ct AS how FROM (SELECT *, CAST(rank() OVER (PARTITION BY c_mktsegment
    ORDER BY c_acctbal DESC) AS INTEGER) AS rank FROM c) WHERE rank <= 5"""),
)(
    lambda t: result(
        t.customer.top_per_group(["c_mktsegment"], ["c_acctbal desc"], 5).select("c_custkey", "c_mktsegment", "rank")
    )
)
query(
    "count_over",
    with_(body="SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey) AS peers, lt AS how FROM l"),
)(lambda t: result(t.lineitem.count_over(["l_suppkey"], "peers").select("l_orderkey", "l_linenumber", "peers")))
EXPRESSIONS = """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority NOT IN ('5-LOW') THEN 'mid'
    ELSE NULL END AS level, substring(o_orderpriority, 1, 2) AS code, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status,
    concat(o_orderstatus, '-', CAST(o_orderkey AS {text})) AS label, replace(o_orderpriority, '-', ' ') AS words,
    (o_totalprice + 1) * 2 - o_totalprice / 4 AS number"""
query(
    "scalar_expressions",
    with_(body=f"""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(o_orderdate + INTERVAL 3 MONTH AS DATE) AS later,
    CAST(o_orderdate - INTERVAL 10 DAY AS DATE) AS sooner, CAST(o_orderdate + INTERVAL 1 YEAR AS DATE) AS next,
    {EXPRESSIONS.format(text='VARCHAR')}, ot AS how FROM o
    WHERE o_orderpriority NOT LIKE '3%' AND o_totalprice NOT BETWEEN 100 AND 1000 AND o_custkey IS NOT NULL"""),
)(
    lambda t: result(
        ProvFrame(
            t.orders.df.filter(
                "o_orderpriority not like '3%' and o_totalprice not between 100 and 1000 and o_custkey is not null"
            ).selectExpr(
                "o_orderkey",
                "extract(year from o_orderdate) as y",
                "cast(o_orderdate + interval 3 month as date) as later",
                "cast(o_orderdate - interval 10 day as date) as sooner",
                "cast(o_orderdate + interval 1 year as date) as next",
                *[e.strip() for e in _split(EXPRESSIONS.format(text="string"))],
                "prov",
            )
        )
    )
)


def _split(text: str) -> list[str]:
    """Cut a select list at its top-level commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


# ---- evaluation and what-if -----------------------------------------------------------------

query(
    "evaluate_tensor",
    with_(body=f"SELECT {GL} AS gate, {GL_VALUES} FROM l GROUP BY l_suppkey"),
)(
    lambda t: ev.gate_values(grouped_lines(t).gate("GL")).select(
        "gate", F.col("qty").cast("double"), "lines", "mean", F.col("low").cast("double"), F.col("high").cast("double"), "parts"
    )
)


def small_line_tokens(t: Tables) -> DataFrame:
    """Tokens of the lines to be deleted."""
    return t.lineitem.filter("l_quantity < 20").df.select(F.col("prov")[0].alias("token"))


KEPT = "FROM l WHERE NOT l_quantity < 20"
query(
    "delete_tokens",
    with_(body=f"SELECT l_suppkey, {GL_VALUES}, {GL} AS how {KEPT} GROUP BY l_suppkey"),
)(
    lambda t: result(
        ev.delete_tokens(grouped_lines(t), small_line_tokens(t)).select(
            "l_suppkey", "qty", "lines", "mean", "low", "high", "parts"
        )
    )
)


def busy(t: Tables) -> ProvFrame:
    """Priorities of orders that have more than three lines, symbolically."""
    lines = group(t.lineitem, ["l_orderkey"], "BU1", {"n": count()}, mode="symbolic")
    lines = having(lines, "n", ">", 3, "symbolic").select("l_orderkey")
    f = t.orders.join(lines, [("o_orderkey", "l_orderkey")])
    return group(f, ["o_orderpriority"], "BU2", {"orders": count()}, mode="symbolic")


def busy_after_deletion(t: Tables) -> DataFrame:
    """Delete lines, decide the conditions again, count again."""
    f = ev.resolve(ev.delete_tokens(busy(t), small_line_tokens(t)))
    return ev.gate_values(f.gate("BU2"))


query(
    "what_if_condition",
    with_(body=f"""SELECT {gate('BU2', 'o_orderpriority')} AS gate, count(*) AS orders FROM o JOIN (SELECT l_orderkey {KEPT}
    GROUP BY l_orderkey HAVING count(*) > 3) ON l_orderkey = o_orderkey GROUP BY o_orderpriority"""),
)(busy_after_deletion)
query(
    "split_terms",
    with_(body=f"""SELECT {gate('BU2', 'o_orderpriority')} AS gate, {prod('ot', gate('BU1', 'l_orderkey'))} AS monomial, n > 3 AS holds
    FROM o JOIN (SELECT l_orderkey, count(*) AS n FROM l GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""),
)(lambda t: ev.split_terms(busy(t), "BU2"))
query(
    "strip_conditions",
    with_(body=f"SELECT o_custkey, {BC_GATE} || '.total' AS total, {BC_GATE} || '.n' AS n, {BC_GATE} AS how {BC}"),
)(lambda t: result(ev.strip_conditions(having(by_customer(t, "symbolic"), "n", ">", 12, "symbolic"))))


def order_weights(t: Tables) -> DataFrame:
    """A valuation: finished orders count 0, urgent ones 2, all other tokens 1."""
    value = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderpriority") == "1-URGENT", 2)
    tokens = t.orders.df.select(F.col("prov")[0].alias("token"), value.alias("value"))
    return tokens.filter(F.col("value").isNotNull())


query(
    "valuation",
    with_(body=f"""SELECT {gate('MIX', 'c_nationkey')} AS how, CAST(sum(w) AS DOUBLE) AS value FROM (
      SELECT c_nationkey, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS w
      FROM c JOIN o ON c_custkey = o_custkey UNION ALL SELECT c_nationkey, 2 FROM c WHERE c_acctbal > 5000) GROUP BY c_nationkey"""),
)(lambda t: ev.valuation(rich_mix(t), order_weights(t)))
query(
    "valuation_nested",
    with_(body=f"""SELECT {prod('ot', gate('HO', 'o_orderkey'))} AS how,
    CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 2 END * count(*) AS DOUBLE) AS value {HO} GROUP BY o_orderkey, ot, o_orderstatus"""),
)(lambda t: ev.valuation(heavy_orders(t), order_weights(t)))
query(
    "evaluate_ratio",
    with_(body=f"SELECT {gate('CO', 'l_returnflag')} AS gate, {_N} / {_G} AS share FROM l GROUP BY l_returnflag"),
)(
    lambda t: ev.gate_values(combined(t).gate("CO")).select(
        "gate", (F.col("net").cast("double") / F.col("gross").cast("double")).alias("share")
    )
)

# ---- validation -------------------------------------------------------------------------------


def plain_q5(t: Tables) -> DataFrame:
    """Q5 written without provenance operators."""
    df = (
        t.read("customer")
        .join(t.read("orders"), F.col("c_custkey") == F.col("o_custkey"))
        .join(t.read("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.read("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .filter("r_name = 'EUROPE' and o_orderdate >= timestamp_ntz'1995-01-01' and o_orderdate < timestamp_ntz'1996-01-01'")
    )
    return df.groupBy("n_name").agg(F.sum(volume()).alias("revenue"))


query("validate_results", with_(body="SELECT 0::BIGINT AS differences"))(
    lambda t: val.differences(plain_q5(t), tpch.q5(t)).agg(F.count(F.lit(1)).alias("differences"))
)
query(
    "validate_results_detects",
    with_(body="""SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_quantity < 10) AS BIGINT) AS surplus FROM l GROUP BY l_returnflag"""),
)(
    lambda t: val.differences(
        t.lineitem.select("l_returnflag").plain(), t.lineitem.filter("l_quantity >= 10").select("l_returnflag")
    )
)


def priced_lines(t: Tables) -> ProvFrame:
    f = join_all(
        [t.lineitem.filter("l_quantity > 30"), t.orders, t.part],
        [("l_orderkey", "o_orderkey"), ("l_partkey", "p_partkey")],
    )
    return f.select("o_orderpriority", "p_brand", (F.col("l_quantity") * F.col("p_retailprice")).alias("worth"))


def replayed(t: Tables) -> DataFrame:
    tables = {"l": val.Witness(t.lineitem, "L"), "o": val.Witness(t.orders, "O"), "p": val.Witness(t.part, "P")}
    where = F.expr("l__l_quantity > 30 and l__l_orderkey = o__o_orderkey and l__l_partkey = p__p_partkey")
    columns = {
        "o_orderpriority": F.col("o__o_orderpriority"),
        "p_brand": F.col("p__p_brand"),
        "worth": F.col("l__l_quantity") * F.col("p__p_retailprice"),
    }
    return val.replay(priced_lines(t), tables, where, columns)


query(
    "validate_witnesses",
    with_(body="""SELECT o_orderpriority, p_brand, l_quantity * p_retailprice AS worth, o_orderpriority AS recomputed_o_orderpriority,
    p_brand AS recomputed_p_brand, l_quantity * p_retailprice AS recomputed_worth, true AS ok
    FROM l JOIN o ON l_orderkey = o_orderkey JOIN p ON l_partkey = p_partkey WHERE l_quantity > 30"""),
)(replayed)
query(
    "validate_derivation_count",
    with_(body=f"SELECT {GL} AS out, count(*) AS terms, count(*) AS cntprov, true AS ok FROM l GROUP BY l_suppkey"),
)(lambda t: val.derivation_count(grouped_lines(t), expand(grouped_lines(t))))
query(
    "resolve_tokens",
    with_(*MIXED, body="""SELECT DISTINCT token, CASE WHEN token[1] = 'C' THEN 'customer' ELSE 'orders' END AS "table",
    CASE WHEN token[1] = 'C' THEN CAST(substr(token, 2) AS BIGINT) END AS c_custkey,
    CASE WHEN token[1] = 'O' THEN CAST(substr(token, 2) AS BIGINT) END AS o_orderkey
    FROM (SELECT unnest(m) AS token FROM mp)"""),
)(
    lambda t: val.resolve_tokens(
        expand(rich_mix(t)).lineage(),
        {"customer": val.Witness(t.customer, "C"), "orders": val.Witness(t.orders, "O")},
    ).select(
        "token",
        "table",
        F.get_json_object("row", "$.c_custkey").cast("long").alias("c_custkey"),
        F.get_json_object("row", "$.o_orderkey").cast("long").alias("o_orderkey"),
    )
)
query(
    "validate_aggregate",
    with_(body=f"SELECT {GL} AS gate, {mean('l_extendedprice')} AS plain, {mean('l_extendedprice')} AS folded, true AS ok FROM l GROUP BY l_suppkey"),
)(lambda t: val.aggregate_check(grouped_lines(t), "mean"))
query(
    "validate_symbolic_q11",
    with_(body="SELECT 0::BIGINT AS differences"),
)(
    lambda t: val.differences(
        tpch.q11(t).plain().withColumn("value", F.col("value").cast("double")), ev.resolve(tpch.q11(t, "symbolic"))
    ).agg(F.count(F.lit(1)).alias("differences"))
)


# ---- what-if through unions, computed columns, scaled aggregates and counts -------------------


def returned_and_numbered(t: Tables) -> ProvFrame:
    returned = group(t.lineitem.filter("l_returnflag = 'R'"), ["l_suppkey"], "UA1", {"n": count()})
    numbered = group(t.lineitem.with_columns(l_number=F.col("l_linenumber").cast("long")), ["l_number"], "UA2", {"n": count()})
    return returned.rename({"l_suppkey": "k"}).union_all(numbered.rename({"l_number": "k"}))


query(
    "union_aggregates_after_deletion",
    with_(body=f"""SELECT l_suppkey AS k, count(*) AS n, {gate('UA1', 'l_suppkey')} AS how {KEPT} AND l_returnflag = 'R' GROUP BY l_suppkey
    UNION ALL SELECT CAST(l_linenumber AS BIGINT), count(*), {gate('UA2', 'l_linenumber')} {KEPT} GROUP BY l_linenumber"""),
)(lambda t: result(ev.delete_tokens(returned_and_numbered(t), small_line_tokens(t))))


def computed(t: Tables) -> ProvFrame:
    g = group(t.lineitem, ["l_suppkey"], "RD", {"n": count(), "s": sum_(money("l_quantity"))})
    return g.with_columns(ratio=F.col("s").cast("double") / F.col("n"))


query(
    "ratio_after_deletion",
    with_(body=f"""SELECT l_suppkey, CAST(sum({dec('l_quantity')}) AS DOUBLE) / count(*) AS ratio, {gate('RD', 'l_suppkey')} AS how
    {KEPT} GROUP BY l_suppkey"""),
)(lambda t: result(ev.delete_tokens(computed(t), small_line_tokens(t)).select("l_suppkey", "ratio")))


def turned(t: Tables) -> ProvFrame:
    aggs = {"low": min_("l_quantity", scale=-1), "high": max_("l_quantity", scale=-2), "hundred": count(scale=100)}
    return group(t.lineitem, ["l_suppkey"], "TD", aggs)


query(
    "scaled_after_deletion",
    with_(body=f"""SELECT l_suppkey, -min(l_quantity) AS low, -2 * max(l_quantity) AS high, 100 * count(*) AS hundred,
    {gate('TD', 'l_suppkey')} AS how {KEPT} GROUP BY l_suppkey"""),
)(lambda t: result(ev.delete_tokens(turned(t), small_line_tokens(t))))


def few_returned(t: Tables) -> ProvFrame:
    returned = t.lineitem.filter("l_returnflag = 'R' AND l_discount < 0.01")
    return scalar_compare(t.supplier, "s_nationkey", ">", returned, count(), "FR", [("s_suppkey", "l_suppkey")], mode="symbolic")


FEW = f"""SELECT s_suppkey, {prod('st', gate('FR', 's_suppkey'))} AS how FROM s WHERE s_nationkey >
    (SELECT count(*) FROM l WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_discount < 0.01"""
query("scalar_count_symbolic", with_(body=f"{FEW})"))(lambda t: result(ev.resolve(few_returned(t)).select("s_suppkey")))
query("scalar_count_after_deletion", with_(body=f"{FEW} AND NOT l_quantity < 20)"))(
    lambda t: result(ev.resolve(ev.delete_tokens(few_returned(t), small_line_tokens(t))).select("s_suppkey"))
)

# ---- conditions on dates and texts; keys that differ in the sign of zero -----------------------


def first_orders(t: Tables) -> ProvFrame:
    g = group(t.orders, ["o_custkey"], "FO", {"first": min_(F.to_date("o_orderdate"))}, mode="symbolic")
    return having(g, "first", "<", F.lit("1993-06-01").cast("date"), "symbolic")


query(
    "having_symbolic_date",
    with_(body=f"""SELECT o_custkey, {gate('FO', 'o_custkey')} AS how FROM o GROUP BY o_custkey
    HAVING min(CAST(o_orderdate AS DATE)) < DATE '1993-06-01'"""),
)(lambda t: result(ev.resolve(first_orders(t)).select("o_custkey")))
query(
    "having_symbolic_text",
    with_(body=f"SELECT p_brand, {gate('LT', 'p_brand')} AS how FROM p GROUP BY p_brand HAVING max(p_name) >= 'part 19'"),
)(
    lambda t: result(
        ev.resolve(
            having(group(t.part, ["p_brand"], "LT", {"last": max_("p_name")}, mode="symbolic"), "last", ">=", "part 19", "symbolic")
        ).select("p_brand")
    )
)
query(
    "group_signed_zero",
    with_(body="SELECT 'SZ[0.0]' AS gate, lt AS monomial, CAST(1 AS BIGINT) AS coef FROM l"),
)(lambda t: group(t.lineitem.with_columns(zero=(F.col("l_quantity") - 25) * F.lit(0.0)), ["zero"], "SZ").circuit())
query(
    "count_over_signed_zero",
    with_(body="SELECT l_orderkey, (SELECT count(*) FROM l) AS n, lt AS how FROM l"),
)(
    lambda t: result(
        t.lineitem.with_columns(zero=(F.col("l_quantity") - 25) * F.lit(0.0)).count_over(["zero"], "n").select("l_orderkey", "n")
    )
)
query(
    "validate_witnesses_grouped",
    with_(body="""SELECT n_name, n_name AS recomputed_n_name, true AS ok FROM l JOIN s ON l_suppkey = s_suppkey
    JOIN n ON s_nationkey = n_nationkey WHERE l_quantity < 5"""),
)(
    lambda t: val.replay(
        flagship(t),
        {"l": val.Witness(t.lineitem, "L"), "s": val.Witness(t.supplier, "S"), "n": val.Witness(t.nation, "N")},
        F.expr("l__l_suppkey = s__s_suppkey and s__s_nationkey = n__n_nationkey and l__l_quantity < 5"),
        {"n_name": F.col("n__n_name")},
    )
)



def busiest(t: Tables) -> ProvFrame:
    """Nations by the number of their suppliers' orders: groups of groups, whose products no check should expand."""
    parts = group(t.lineitem.filter("l_quantity < 10"), ["l_orderkey", "l_suppkey"], "VO", {"lines": count()})
    f = parts.join(t.supplier, [("l_suppkey", "s_suppkey")]).join(t.nation, [("s_nationkey", "n_nationkey")])
    return group(f, ["n_name"], "VN", {"orders": count(), "lines": sum_("lines")}).select("n_name")


def circuit_checked(t: Tables) -> DataFrame:
    line, supplier, nation = val.Witness(t.lineitem, "L"), val.Witness(t.supplier, "S"), val.Witness(t.nation, "N")
    steps = {
        "VO": val.Step(
            {"l_orderkey": F.col("l__l_orderkey"), "l_suppkey": F.col("l__l_suppkey")}, {"l": line}, where=F.expr("l__l_quantity < 10")
        ),
        "VN": val.Step(
            {"n_name": F.col("n__n_name")}, {"s": supplier, "n": nation}, {"o": "VO"},
            F.expr("o__l_suppkey = s__s_suppkey and s__s_nationkey = n__n_nationkey"),
        ),
    }
    return val.replay_circuit(busiest(t), val.Step({"n_name": F.col("g__n_name")}, gates={"g": "VN"}), steps)


FEW_LINES = "l WHERE l_quantity < 10"
SENT = "FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM l WHERE l_quantity < 10) JOIN s ON l_suppkey = s_suppkey JOIN n ON s_nationkey = n_nationkey"
query(
    "validate_circuit",
    with_(body=f"""SELECT {gate('VO', 'l_orderkey', 'l_suppkey')} AS token, count(*) AS members, CAST(0 AS BIGINT) AS failed
    FROM {FEW_LINES} GROUP BY l_orderkey, l_suppkey
    UNION ALL SELECT {gate('VN', 'n_name')}, count(*), CAST(0 AS BIGINT) {SENT} GROUP BY n_name
    UNION ALL SELECT {gate('VN', 'n_name')}, CAST(1 AS BIGINT), CAST(0 AS BIGINT) {SENT} GROUP BY n_name"""),
)(circuit_checked)

# ---- the derivations behind subqueries whose rows carry only a gate token ------------------------

query(
    "in_correlated_circuit",
    circuit_sql((gate("INC", "c_nationkey", "l_suppkey"), prod("ct", "ot", "lt"), """FROM c JOIN o ON c_custkey = o_custkey
    JOIN l ON l_orderkey = o_orderkey""")),
)(
    lambda t: in_(
        t.supplier,
        join_all([t.customer, t.orders, t.lineitem], [("c_custkey", "o_custkey"), ("o_orderkey", "l_orderkey")]),
        [("s_nationkey", "c_nationkey")], "INC", [("s_suppkey", "l_suppkey")],
    ).circuit()
)
query("scalar_circuit", circuit_sql((gate("SCU"), "ot", "FROM o")))(
    lambda t: scalar_compare(
        t.orders, "o_totalprice", ">", t.orders.prefixed("i_"), avg(money("i_o_totalprice")), "SCU"
    ).circuit()
)
query("scalar_correlated_tensor", with_(body=f"""SELECT {gate('SCT', 'o_custkey')} AS gate, ot AS monomial,
    CAST({dec('o_totalprice')} AS VARCHAR) AS value, CAST(1 AS BIGINT) AS coef FROM o"""))(
    lambda t: scalar_compare(
        t.orders, "o_totalprice", ">", t.orders.prefixed("i_"), avg(money("i_o_totalprice")), "SCT",
        [("o_custkey", "i_o_custkey")],
    ).tensor("v")
)
query("scalar_or_circuit", circuit_sql((gate("SCO", "o_custkey"), "ot", "FROM o")))(
    lambda t: scalar_compare(
        t.orders, "o_totalprice", ">", t.orders.prefixed("i_"), avg(money("i_o_totalprice")), "SCO",
        [("o_custkey", "i_o_custkey")], or_where=F.col("o_orderpriority") == "5-LOW",
    ).circuit()
)
query("all_circuit", circuit_sql((gate("ALC", "s_nationkey"), "st", "FROM s WHERE s_acctbal > 0")))(
    lambda t: all_compare(
        t.customer, "c_acctbal", "<", t.supplier.filter("s_acctbal > 0"), "s_acctbal", "ALC", [("c_nationkey", "s_nationkey")]
    ).circuit()
)
query(
    "row_compare_circuit",
    circuit_sql((gate("RWC", "c_nationkey", "c_acctbal"), "st", """FROM (SELECT DISTINCT c_nationkey, c_acctbal FROM c) JOIN s
    ON c_nationkey > s_nationkey OR (c_nationkey = s_nationkey AND c_acctbal > s_acctbal)""")),
)(
    lambda t: derivations_of(
        any_compare(t.customer, ["c_nationkey", "c_acctbal"], ">", t.supplier, ["s_nationkey", "s_acctbal"], "RWC"), "RWC"
    )
)
query("exists_multiplicity_circuit", circuit_sql((gate("MUL", "c_custkey"), "ct", "FROM c WHERE c_acctbal > 0")))(
    lambda t: shared_key(t).circuit()
)

# ---- several correlated comparisons, groups of them, row values, NULLs in lists -------------------


def undercut(t: Tables) -> ProvFrame:
    """Orders for which the same customer has an earlier and dearer one."""
    return semi_join(t.orders, t.orders.prefixed("i_"), [("o_custkey", "i_o_custkey")], "TWO", TWO)


TWO = [("o_orderkey", ">", "i_o_orderkey"), ("o_totalprice", "<", "i_o_totalprice")]
TWO_SQL = "i.o_custkey = o.o_custkey AND i.o_orderkey < o.o_orderkey AND i.o_totalprice > o.o_totalprice"
TWO_GATE = gate("TWO", "o.o_custkey", "o.o_orderkey", "o.o_totalprice")
query(
    "exists_two_ranges",
    with_(body=f"""SELECT o_orderkey, o_orderkey AS by_key FROM o WHERE EXISTS (SELECT * FROM o i WHERE {TWO_SQL})"""),
)(lambda t: undercut(t).select("o_orderkey", F.col("o_orderkey").alias("by_key")).plain())
query(
    "exists_two_ranges_circuit",
    with_(body=f"""SELECT o.ot AS row, i.ot AS monomial, CAST(1 AS BIGINT) AS coef FROM o JOIN o i ON {TWO_SQL}"""),
)(
    lambda t: derivations_of(undercut(t), "TWO").select(
        F.concat(F.lit("O"), F.element_at(F.split("gate", "\\|"), 2)).alias("row"), "monomial", "coef"
    )
)
query(
    "not_exists_two_ranges",
    with_(body=f"SELECT o_orderkey, ot AS how FROM o WHERE NOT EXISTS (SELECT * FROM o i WHERE {TWO_SQL})"),
)(
    lambda t: result(
        anti_join(t.orders, t.orders.prefixed("i_"), [("o_custkey", "i_o_custkey")], TWO).select("o_orderkey")
    )
)


def either(t: Tables) -> ProvFrame:
    """Suppliers of whose nation some customer is richer, or else has a smaller number and another segment than AUTOMOBILE."""
    rich = t.customer.filter("c_acctbal > 9000")
    return semi_join(
        t.supplier, rich, [("s_nationkey", "c_nationkey")], "OR",
        either=[[("s_acctbal", "<", "c_acctbal")], [("s_suppkey", ">", "c_custkey"), ("s_name", "<>", "c_mktsegment")]],
    )


OR_SQL = """c_acctbal > 9000 AND s_nationkey = c_nationkey AND (s_acctbal < c_acctbal OR s_suppkey > c_custkey AND s_name <> c_mktsegment)"""
query("exists_or_group", with_(body=f"SELECT s_suppkey FROM s WHERE EXISTS (SELECT * FROM c WHERE {OR_SQL})"))(
    lambda t: either(t).select("s_suppkey").plain()
)
query(
    "exists_or_group_circuit",
    with_(body=f"""SELECT CAST(s_nationkey AS VARCHAR) AS nation, ct AS monomial, count(*) AS coef FROM s JOIN c ON {OR_SQL} GROUP BY ALL"""),
)(
    lambda t: derivations_of(either(t), "OR", by=F.regexp_extract("out", r"OR\[(\d+)", 1))
    .groupBy(F.col("gate").alias("nation"), "monomial")
    .agg(F.sum("coef").alias("coef"))
)


def above_earlier(t: Tables) -> ProvFrame:
    """Orders dearer than the mean of the customer's earlier ones."""
    return scalar_compare(
        t.orders, "o_totalprice", ">", t.orders.prefixed("i_"), avg(money("i_o_totalprice")), "SR",
        [("o_custkey", "i_o_custkey")], residual=("o_orderkey", ">", "i_o_orderkey"),
    )


EARLIER = "i.o_custkey = o.o_custkey AND i.o_orderkey < o.o_orderkey"
query(
    "scalar_range_correlated",
    with_(body=f"""SELECT o_orderkey, {prod('ot', gate('SR', 'o_custkey', 'o_orderkey'))} AS how FROM o
    WHERE o_totalprice > (SELECT CAST(sum({dec('i.o_totalprice')}) AS DOUBLE) / count(*) FROM o i WHERE {EARLIER})"""),
)(lambda t: result(above_earlier(t).select("o_orderkey")))
query(
    "scalar_range_correlated_circuit",
    circuit_sql((gate("SR", "o.o_custkey", "o.o_orderkey"), "i.ot", f"FROM o JOIN o i ON {EARLIER}")),
)(lambda t: derivations_of(above_earlier(t), "SR"))


def blanked(t: Tables) -> tuple[ProvFrame, ProvFrame]:
    """Customers and suppliers, some of whose nations and balances are not known."""
    c = t.customer.with_columns(cn=F.expr("case when c_custkey % 7 <> 0 then c_nationkey end"), cb=F.expr("case when c_custkey % 11 <> 0 then c_custkey % 40 end"))
    s = t.supplier.with_columns(sn=F.expr("case when (s_suppkey + 1) % 50 <> 0 then s_nationkey end"), sb=F.expr("case when s_suppkey % 30 <> 0 then s_suppkey % 40 end"))
    return c, s


BLANKED = (
    "bc AS (SELECT *, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS cn, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 40 END AS cb FROM c)",
    "bs AS (SELECT *, CASE WHEN (s_suppkey + 1) % 50 <> 0 THEN s_nationkey END AS sn, CASE WHEN s_suppkey % 30 <> 0 THEN s_suppkey % 40 END AS sb FROM s)",
)
NOT_IN_SQL = "NOT EXISTS (SELECT * FROM bs WHERE {} coalesce(sn = cn, true) AND coalesce(sb = cb, true))"
query("not_in_columns", with_(*BLANKED, body=f"SELECT c_custkey, ct AS how FROM bc WHERE {NOT_IN_SQL.format('')}"))(
    lambda t: result(not_in(*blanked(t), ["cn", "cb"], ["sn", "sb"]).select("c_custkey"))
)
query(
    "not_in_columns_correlated",
    with_(*BLANKED, body=f"SELECT c_custkey, ct AS how FROM bc WHERE {NOT_IN_SQL.format('s_nationkey = c_nationkey AND')}"),
)(lambda t: result(not_in(*blanked(t), ["cn", "cb"], ["sn", "sb"], [("c_nationkey", "s_nationkey")]).select("c_custkey")))


def any_typed(t: Tables, column: str, other: str, op: str, name: str) -> ProvFrame:
    return any_compare(t.supplier, column, op, t.customer.filter("c_acctbal > 9500"), other, name, [("s_nationkey", "c_nationkey")])


for _kind, _x, _y, _op in (("double", "s_acctbal", "c_acctbal", "<"), ("text", "s_name", "c_name", ">=")):
    query(
        f"any_{_kind}_circuit",
        circuit_sql((gate(f"AN{_kind}", "s_nationkey", _x), "ct", f"FROM s JOIN c ON s_nationkey = c_nationkey AND {_x} {_op} {_y} WHERE c_acctbal > 9500")),
    )(lambda t, k=_kind, x=_x, y=_y, o=_op: derivations_of(any_typed(t, x, y, o, f"AN{k}"), f"AN{k}"))

query(
    "scalar_row_compare",
    with_(body=f"""SELECT c_custkey, {prod('ct', gate('SRW', 'c_nationkey'))} AS how FROM c JOIN (SELECT s_nationkey, min(s_suppkey) AS a,
    max(s_acctbal) AS b FROM s GROUP BY s_nationkey) ON s_nationkey = c_nationkey WHERE c_custkey > a OR c_custkey = a AND c_acctbal > b"""),
)(
    lambda t: result(
        scalar_compare(
            t.customer, ["c_custkey", "c_acctbal"], ">", t.supplier, [min_("s_suppkey"), max_("s_acctbal")], "SRW", [("c_nationkey", "s_nationkey")]
        ).select("c_custkey")
    )
)
query(
    "all_row_compare",
    with_(body=f"""SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM s) THEN {prod('ct', gate('ARW', 'c_nationkey'))} ELSE ct END AS how
    FROM c WHERE NOT EXISTS (SELECT * FROM s WHERE s_nationkey = c_nationkey AND NOT (c_custkey > s_suppkey OR c_custkey = s_suppkey AND c_acctbal > s_acctbal))"""),
)(
    lambda t: result(
        all_compare(t.customer, ["c_custkey", "c_acctbal"], ">", t.supplier, ["s_suppkey", "s_acctbal"], "ARW", [("c_nationkey", "s_nationkey")]).select("c_custkey")
    )
)

# ---- what-if through filters on aggregates: rows leave and enter -----------------------------------


def few_or_many(t: Tables) -> ProvFrame:
    """Orders with under three or over six lines, and how many."""
    return group(t.lineitem, ["l_orderkey"], "FM", {"n": count(), "qty": sum_(money("l_quantity"))}).filter("n < 3 or n > 6")


query(
    "having_resolved_after_deletion",
    with_(body=f"""SELECT l_orderkey, count(*) AS n, CAST(sum({dec('l_quantity')}) AS DOUBLE) AS qty, {gate('FM', 'l_orderkey')} AS how
    {KEPT} GROUP BY l_orderkey HAVING count(*) < 3 OR count(*) > 6"""),
)(lambda t: result(ev.delete_tokens(few_or_many(t), small_line_tokens(t))))
query(
    "scalar_resolved_after_deletion",
    with_(body=f"""SELECT o_orderkey, {prod('ot', gate('SD', 'o_orderkey'))} AS how FROM o
    WHERE o_totalprice < (SELECT min(l_extendedprice) * 8 {KEPT} AND l_orderkey = o_orderkey)"""),
)(
    lambda t: result(
        ev.delete_tokens(
            scalar_compare(t.orders, "o_totalprice", "<", t.lineitem, min_("l_extendedprice", scale=8), "SD", [("o_orderkey", "l_orderkey")]),
            small_line_tokens(t),
        ).select("o_orderkey")
    )
)
query(
    "aggregate_of_aggregate_after_deletion",
    with_(body=f"""SELECT o_orderpriority, CAST(max(qty) AS DOUBLE) AS most, CAST(sum(qty) AS DOUBLE) AS total, {gate('SS2', 'o_orderpriority')} AS how
    FROM o JOIN (SELECT l_orderkey, sum({dec('l_quantity')}) AS qty {KEPT} GROUP BY l_orderkey) ON l_orderkey = o_orderkey GROUP BY o_orderpriority"""),
)(lambda t: result(ev.delete_tokens(sums_of_sums(t), small_line_tokens(t))))
query(
    "theta_join_ordered",
    with_(body=f"SELECT s_suppkey, n_nationkey, {prod('st', 'nt')} AS how FROM s JOIN n ON s_suppkey < n_nationkey"),
)(lambda t: result(t.supplier.theta_join(t.nation, order=("s_suppkey", "<", "n_nationkey")).select("s_suppkey", "n_nationkey")))
