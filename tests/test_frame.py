import random

import pytest
from helpers import hows, poly, polynomials
from pyspark.sql import functions as F

from whence import distinct, group, having, join_all, union
from whence.functions.aggregates import avg, count, count_distinct, derivations, max_, min_, sum_
from whence.operators.grouping import self_join
from whence.operators.subquery import semi_join


@pytest.fixture
def people(frame):
    return frame("C", "c int, town string", [(1, "x"), (2, "x"), (3, "y"), (4, None)])


@pytest.fixture
def orders(frame):
    return frame("O", "o int, oc int, price int", [(1, 1, 10), (2, 1, 30), (3, 2, 20), (4, 9, 5), (5, None, 7)])


def test_inner_left_right(people, orders):
    on = [("c", "oc")]
    assert hows(people.join(orders, on), "c", "o") == {(1, 1): "C1 . O1", (1, 2): "C1 . O2", (2, 3): "C2 . O3"}
    left = hows(people.join(orders, on, "left"), "c", "o")
    assert left[(3, None)] == "C3" and left[(4, None)] == "C4" and len(left) == 5
    right = hows(people.join(orders, on, "right"), "c", "o")
    assert right[(None, 4)] == "O4" and right[(None, 5)] == "O5" and len(right) == 5


def test_join_rules(people, orders):
    with pytest.raises(ValueError, match="not supported"):
        people.join(orders, [("c", "oc")], "full")
    with pytest.raises(ValueError, match="ambiguous"):
        people.join(people, [("c", "c")])
    with pytest.raises(ValueError, match="no join keys"):
        people.join(orders, [])
    with pytest.raises(ValueError, match="no equality"):
        join_all([people, orders], [])
    with pytest.raises(ValueError, match="reserved"):
        people.rename({"c": "prov"})
    with pytest.raises(ValueError, match="names for"):
        people.to_columns("a")


def test_intersect_and_except_are_refused(people):
    for op in (people.intersect, people.except_):
        with pytest.raises(ValueError):
            op(people)


def test_theta_cross_band_against_brute_force(frame):
    rng = random.Random(3)
    a = [(i, rng.randint(-20, 20)) for i in range(60)]
    b = [(i, lo := rng.randint(-20, 20), lo + rng.randint(-2, 6)) for i in range(50)]
    fa, fb = frame("A", "a int, x int", a), frame("B", "b int, lo int, hi int", b)
    got = {(r["a"], r["b"]) for r in fa.theta_join(fb, F.expr("x < lo and x <> hi")).how().collect()}
    assert got == {(i, j) for i, x in a for j, lo, hi in b if x < lo and x != hi}
    got = [(r["a"], r["b"]) for r in fa.band_join(fb, "x", "lo", "hi", 4).how().collect()]
    assert sorted(got) == sorted((i, j) for i, x in a for j, lo, hi in b if lo <= x <= hi)
    got = hows(fa.cross_join(fb), "a", "b")
    assert len(got) == 3000 and got[(3, 4)] == "A3 . B4"


def test_or_condition(people, orders):
    f = people.join(orders, [("c", "oc")], where=F.expr("(c = 1 and price > 20) or (c = 2 and price < 30)"))
    assert hows(f, "c", "o") == {(1, 2): "C1 . O2", (2, 3): "C2 . O3"}


def test_self_join_gives_exponents_and_coefficients(people):
    both = people.join(people.prefixed("b_"), [("town", "b_town")])
    got = polynomials(distinct(both.select("town"), "T"), "town")
    assert got == {"x": poly("C1 C1", "C1 C2", "C1 C2", "C2 C2"), "y": poly("C3 C3")}
    factored = self_join(people.filter("town is not null"), ["town"], "S")
    assert polynomials(factored, "town") == got
    assert {r["town"]: r["pairs"] for r in factored.how().collect()} == {"x": 4, "y": 1}


def test_group_values_and_null_key(orders):
    aggs = {
        "s": sum_("price"), "n": count(), "k": count("oc"), "m": avg("price"), "lo": min_("price"), "hi": max_("price"),
        "d": count_distinct("price"), "cntprov": derivations(),
    }
    rows = {r["oc"]: r for r in group(orders, ["oc"], "G", aggs).how().collect()}
    assert rows[1]["s"] == 40 and rows[1]["m"] == 20.0 and rows[1]["cntprov"] == 2 and rows[1]["how"] == "G[1]"
    assert rows[None]["how"] == "G[\\N]" and rows[None]["k"] == 0 and rows[None]["n"] == 1


def test_keys_with_separators_do_not_collide(frame):
    f = frame("T", "t int, a string, b string", [(1, "x|y", "z"), (2, "x", "y|z"), (3, "x\\", "y"), (4, "x", "\\y")])
    g = group(f, ["a", "b"], "G", {"n": count()})
    assert len(set(hows(g, "a", "b").values())) == 4
    assert {r["n"] for r in g.how().collect()} == {1}


def test_group_over_empty_input(orders):
    none = orders.filter("price > 1000")
    (row,) = group(none, [], "G", {"n": count(), "s": sum_("price")}).how().collect()
    assert row["n"] == 0 and row["s"] is None
    assert group(none, ["oc"], "H", {"n": count()}).how().collect() == []


def test_union_sums_annotations(people, orders):
    a = people.select(F.col("c").alias("k"))
    b = orders.select(F.col("oc").alias("k")).filter("k is not null")
    assert polynomials(union([a, b], "U"), "k") == {
        1: poly("C1", "O1", "O2"), 2: poly("C2", "O3"), 3: poly("C3"), 4: poly("C4"), 9: poly("O4"),
    }
    wide = a.union_all(orders.select("price"), allow_missing=True)
    assert len(wide.how().collect()) == 9 and wide.columns == ["k", "price"]


def test_expand_reaches_through_joins_and_groups(people, orders):
    per = group(orders, ["oc"], "P", {"s": sum_("price")})
    f = people.join(per, [("c", "oc")])
    top = group(f, ["town"], "T", {"best": max_("s")})
    assert hows(top, "town") == {"x": "T[x]"}
    assert polynomials(top, "town") == {"x": poly("C1 O1", "C1 O2", "C2 O3")}
    # rows with and without the inner token
    left = people.join(per, [("c", "oc")], "left")
    assert polynomials(left, "c")[3] == poly("C3") and polynomials(left, "c")[1] == poly("C1 O1", "C1 O2")


def test_gate_names_are_unique(people, orders):
    g = group(orders, ["oc"], "G", {"n": count()})
    with pytest.raises(ValueError, match="taken"):
        group(g, ["n"], "G", {"m": count()})
    other = group(orders.filter("price > 5"), ["oc"], "G", {"n": count()}).to_columns("oc2", "n2")
    with pytest.raises(ValueError, match="two different gates"):
        g.join(other, [("oc", "oc2")])


def test_rows_used_twice_are_expanded_once(orders):
    g = group(orders, ["oc"], "G", {"n": count()})
    twice = g.order_by("oc").limit(2).union_all(g.order_by(F.desc("oc")).limit(5))
    assert polynomials(twice, "oc")[1] == poly("O1", "O2")


def test_having_operators(orders):
    for op, want in {"=": {1}, "<>": {2, 9, None}, ">": set(), ">=": {1}, "<": {2, 9, None}, "<=": {1, 2, 9, None}}.items():
        g = having(group(orders, ["oc"], "G", {"n": count()}), "n", op, 2)
        assert {r["oc"] for r in g.how().collect()} == want
    with pytest.raises(ValueError):
        having(group(orders, ["oc"], "G", {"n": count()}), "n", "~", 2)
    with pytest.raises(ValueError):
        having(group(orders, ["oc"], "G", {"n": count()}), "n", "=", 2, mode="other")


def test_windows_and_top(orders, people):
    f = people.count_over(["town"], "peers")
    assert {r["c"]: r["peers"] for r in f.how().collect()} == {1: 2, 2: 2, 3: 1, 4: 1}
    top = orders.top_per_group(["oc"], ["price desc"], 1)
    assert {r["o"] for r in top.how().collect()} == {2, 3, 4, 5}


def test_reachable_circuit_keeps_only_used_gates(people, orders):
    f = semi_join(people, orders, [("c", "oc")], "E").filter("c = 1")
    assert sorted(map(tuple, f.circuit(reachable=True).collect())) == [("E[1]", "O1", 1), ("E[1]", "O2", 1)]
    assert len(f.circuit().collect()) == 4


def test_tensor_references_follow_renaming(people, orders):
    g = group(orders, ["oc"], "G", {"n": count()}).rename({"n": "num"})
    f = people.join(g, [("c", "oc")]).select("c", "num").tensor_refs()
    assert {r["c"]: r["num_agg"] for r in f.how().collect()} == {1: "G[1].n", 2: "G[2].n"}
    assert {(r["gate"], r["monomial"], r["value"]) for r in f.tensor("n").collect()} >= {("G[1]", "O1", "1")}
