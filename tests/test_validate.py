from pyspark.sql import functions as F

from whence import expand, group
from whence.functions.aggregates import avg, count, derivations, sum_
from whence.operators import validate as val
from whence.operators.points import distance_join, equal_points, nearest, place_join, within_distance
from whence.sources.tokens import annotate_ordinal
from helpers import hows, polynomials


def test_differences_counts_copies_and_rounds(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0 + 1e-9), ("y", 2.0), ("x", 1.0)], "k string, v double")
    assert val.differences(a, b).collect() == []
    c = spark.createDataFrame([("x", 1.0), ("y", 2.5), ("y", 2.0)], "k string, v double")
    assert {(r["k"], float(r["v"]), r["surplus"]) for r in val.differences(a, c).collect()} == {("x", 1.0, 1), ("y", 2.5, -1)}


def test_replay_finds_wrong_rows(frame):
    a = frame("A", "a int, k int", [(1, 1), (2, 2)])
    b = frame("B", "b int, j int, v int", [(1, 1, 5), (2, 2, 6)])
    f = a.join(b, [("k", "j")]).select("k", "v")
    tables = {"x": val.Witness(a, "A"), "y": val.Witness(b, "B")}
    check = lambda g: sorted((r["k"], r["ok"]) for r in val.replay(
        g, tables, F.col("x__k") == F.col("y__j"), {"k": F.col("x__k"), "v": F.col("y__v")}).collect())
    assert check(f) == [(1, True), (2, True)]
    assert check(f.with_columns(v=F.when(F.col("k") == 2, 7).otherwise(F.col("v")))) == [(1, True), (2, False)]


def test_replay_of_a_self_join(frame):
    n = frame("N", "n int, r int", [(1, 0), (2, 0)])
    f = n.prefixed("a_").join(n.prefixed("b_"), [("a_r", "b_r")]).filter("a_n < b_n").select("a_n", "b_n")
    ordered = f._with(f.df.withColumn("prov", F.sort_array("prov")))
    tables = {"x": val.Witness(n, "N", 0), "y": val.Witness(n, "N", 1)}
    got = val.replay(ordered, tables, F.expr("x__r = y__r"), {"a_n": F.col("x__n"), "b_n": F.col("y__n")}).collect()
    assert [(r["a_n"], r["b_n"], r["ok"]) for r in got] == [(1, 2, True)]


def test_tokens_of_many_files_and_qualified_tables(spark, tmp_path):
    spark.range(60).selectExpr("id", "id % 4 as g").repartition(12).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for name in (None, "sales:t"):
        f = annotate_ordinal(df, "T", qualified=name)
        w = val.Witness(f, "T")
        lineage = f.df.select(F.explode("prov").alias("token"))
        assert val.resolve_tokens(lineage, {"t": w}).count() == 60
        check = val.replay(f, {"t": w}, F.lit(True), {"id": F.col("t__id")})
        assert check.count() == 60 and check.filter("ok").count() == 60


def test_replay_of_a_grouped_result(frame):
    a = frame("A", "a int, k int", [(1, 1), (2, 2), (3, 2)])
    b = frame("AB", "b int, j int, v int", [(1, 1, 5), (2, 2, 6)])  # its tokens begin like those of A
    g = group(a.join(b, [("k", "j")]), ["v"], "G", {"n": count()})
    tables = {"x": val.Witness(a, "A"), "y": val.Witness(b, "AB")}
    got = val.replay(g, tables, F.expr("x__k = y__j"), {"v": F.col("y__v")}).collect()
    assert sorted((r["v"], r["ok"]) for r in got) == [(5, True), (6, True), (6, True)]
    wrong = val.replay(g, tables, F.expr("x__k = y__j"), {"v": F.col("y__v") + (F.col("x__a") == 3).cast("int")}).collect()
    assert sorted((r["v"], r["ok"]) for r in wrong) == [(5, True), (6, False), (6, True)]


def test_counts_aggregates_and_tokens(frame):
    f = frame("L", "l int, g int, v int", [(1, 1, 4), (2, 1, 6), (3, 2, None)])
    g = group(f, ["g"], "G", {"m": avg("v"), "s": sum_("v"), "n": count(), "cntprov": derivations()})
    assert all(r["ok"] for r in val.derivation_count(g, expand(g)).collect())
    for alias in ("m", "s", "n"):
        assert all(r["ok"] for r in val.aggregate_check(g, alias).collect())
    wrong = g._with(g.df.withColumn("n", F.col("n") + 1), tensor_columns={"n": (("G", "n"),)})
    assert not any(r["ok"] for r in val.aggregate_check(wrong, "n").collect())
    found = val.resolve_tokens(expand(g).lineage(), {"lines": val.Witness(f, "L")})
    assert {(r["token"], r["table"]) for r in found.collect()} == {(f"L{i}", "lines") for i in (1, 2, 3)}


def points(frame, prefix, rows):
    p = prefix.lower()
    return frame(prefix, f"{p} int, {p}x double, {p}y double", rows)


def test_distance_join_against_brute_force(frame):
    import math
    import random

    rng = random.Random(8)
    cloud = lambda n: [(i, rng.choice([0.25, rng.uniform(-1, 1)]), rng.uniform(-1, 1)) for i in range(n)]
    a, b = cloud(60), cloud(50)
    fa, fb = points(frame, "A", a), points(frame, "B", b)
    near = lambda p, q: math.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) <= 0.3
    want = sorted((p[0], q[0]) for p in a for q in b if near(p, q))
    f = distance_join(fa, fb, ("ax", "ay"), ("bx", "by"), 0.3)
    assert sorted((r["a"], r["b"]) for r in f.how().collect()) == want
    assert sum(r["pairs"] for r in place_join(fa, fb, ("ax", "ay"), ("bx", "by"), 0.3, ("P", "Q")).how().collect()) == len(want)
    got = {r["a"] for r in within_distance(fa, "ax", "ay", 0.1, 0.1, 0.5).how().collect()}
    assert got == {i for i, x, y in a if math.sqrt((x - 0.1) ** 2 + (y - 0.1) ** 2) < 0.5}
    best = [r["a"] for r in nearest(fa, "ax", "ay", 0.0, 0.0, 5, ["a"]).how().collect()]
    assert best == [p[0] for p in sorted(a, key=lambda p: (math.sqrt(p[1] ** 2 + p[2] ** 2), p[0]))[:5]]


def test_equal_points_expand_to_pairs(frame):
    f = points(frame, "A", [(1, 0.5, 0.5), (2, 0.5, 0.5), (3, 1.0, 0.0)])
    e = equal_points(f, ("ax", "ay"), "E")
    assert hows(e, "ax")[0.5] == "E[0.5|0.5] . E[0.5|0.5]"
    assert sum(polynomials(e, "ax")[0.5].values()) == 4
    assert polynomials(e, "ax")[0.5][("A1", "A2")] == 2


def two_levels(frame, lines):
    """Lines grouped by order, orders grouped by customer's country."""
    orders = frame("O", "o int, place string", [(1, "x"), (2, "x"), (3, "y")])
    low = group(lines, ["k"], "G", {"n": count()})
    f = group(low.join(orders, [("k", "o")]), ["place"], "P", {"m": sum_("n")}).select("place")
    steps = lambda base: {
        "G": val.Step({"k": F.col("l__k")}, {"l": val.Witness(base, "L")}),
        "P": val.Step({"place": F.col("o__place")}, {"o": val.Witness(orders, "O")}, {"g": "G"}, F.expr("g__k = o__o")),
    }
    return f, val.Step({"place": F.col("p__place")}, gates={"p": "P"}), steps


def verdicts(df):
    return sorted((r["token"], r["members"], r["failed"]) for r in df.collect())


def test_circuit_replay_agrees_and_carries_failures_up(frame):
    rows = [(1, 1), (2, 1), (3, 2), (4, 3)]
    lines = frame("L", "l int, k int", rows)
    f, top, steps = two_levels(frame, lines)
    good = [("G[1]", 2, 0), ("G[2]", 1, 0), ("G[3]", 1, 0), ("P[x]", 1, 0), ("P[x]", 2, 0), ("P[y]", 1, 0), ("P[y]", 1, 0)]
    assert verdicts(val.replay_circuit(f, top, steps(lines))) == good
    # line 2 belongs to another order in the table the check reads, line 4 is not there
    other = frame("L", "l int, k int", [(1, 1), (2, 9), (3, 2)])
    bad = [("G[1]", 2, 1), ("G[2]", 1, 0), ("G[3]", 1, 1), ("P[x]", 1, 1), ("P[x]", 2, 1), ("P[y]", 1, 1), ("P[y]", 1, 1)]
    assert verdicts(val.replay_circuit(f, top, steps(other))) == bad
    wrong = f._with(f.df.withColumn("place", F.upper("place")), same_rows=True)
    assert [x for x in verdicts(val.replay_circuit(wrong, top, steps(lines))) if x[2]] == [("P[x]", 1, 1), ("P[y]", 1, 1)]


def test_circuit_replay_needs_a_step_for_every_gate_and_no_spare_tokens(frame):
    import pytest

    lines = frame("L", "l int, k int", [(1, 1), (2, None), (3, None)])
    f, top, steps = two_levels(frame, lines)
    with pytest.raises(ValueError, match="G"):
        val.replay_circuit(f, top, {"P": steps(lines)["P"]})
    g = group(lines, ["k"], "G")
    step = {"G": steps(lines)["G"]}
    assert verdicts(val.replay_circuit(g, val.Step({"k": F.col("g__k")}, gates={"g": "G"}), step)) == [
        ("G[1]", 1, 0), ("G[1]", 1, 0), ("G[\\N]", 1, 0), ("G[\\N]", 2, 0)]
    spare = g._with(g.df.withColumn("prov", F.concat("prov", F.array(F.lit("L1")))), same_rows=True)
    assert all(r[2] for r in verdicts(val.replay_circuit(spare, val.Step({"k": F.col("g__k")}, gates={"g": "G"}), step)) if "." in r[0])


def test_circuit_replay_does_not_expand_products(frame):
    from whence.operators.grouping import self_join

    lines = frame("L", "l int, k int", [(i, i % 2) for i in range(6000)])
    f = self_join(lines, ["k"], "J")  # 18 million pairs
    step = val.Step({"k": F.col("l__k")}, {"l": val.Witness(lines, "L")})
    top = val.Step({"k": F.col("a__k")}, gates={"a": "J", "b": "J"}, where=F.expr("a__k = b__k"))
    assert verdicts(val.replay_circuit(f, top, {"J": step})) == [
        ("J[0]", 3000, 0), ("J[0] . J[0]", 1, 0), ("J[1]", 3000, 0), ("J[1] . J[1]", 1, 0)]


def near_pairs(a, b, r):
    import math

    return sorted(
        (f"A{p[0]}", f"B{q[0]}") for p in a for q in b if math.sqrt((p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2])) <= r
    )


def crowd(seed, n, around, width):
    import random

    rng = random.Random(seed)
    return [(rng.uniform(*around) + rng.uniform(-width, width), rng.uniform(*around) + rng.uniform(-width, width)) for _ in range(n)]


def numbered(points, first=0):
    return [(first + i, x, y) for i, (x, y) in enumerate(points)]


def test_cell_join_expands_to_the_pairs_of_brute_force(frame):
    from whence.operators.cells import cell_join

    a = numbered(crowd(1, 60, (-1, 1), 0) + crowd(2, 120, (0.2, 0.2), 0.08) + [(0.5, 0.5)] * 40 + [(-0.3, 0.0), (0.0, 0.0)])
    b = numbered(crowd(3, 60, (-1, 1), 0) + crowd(4, 120, (0.35, 0.35), 0.1) + [(0.5, 0.5)] * 40 + [(0.0, 0.0), (0.3, 0.0)])
    odd = [(900, None, 0.0), (901, float("nan"), 0.0), (902, float("inf"), 0.0)]
    fa, fb = points(frame, "A", a + odd), points(frame, "B", b + odd)
    for most in (1, 16, 10**6):
        f = cell_join(fa, fb, ("ax", "ay"), ("bx", "by"), 0.3, ("P", "Q"), pairs=most)
        terms = [(tuple(r["m"]), r["c"]) for r in expand(f).terms.collect()]
        assert sorted(terms) == [(p, 1) for p in near_pairs(a, b, 0.3)]
        rows = f.df.collect()
        assert sum(r["pairs"] for r in rows) == len(terms)
        if most < 10**6:  # crowded places are one row
            assert len(rows) < len(terms) / 2 and max(r["pairs"] for r in rows) >= 1600
    assert cell_join(fa, fb, ("ax", "ay"), ("bx", "by"), 0.3, ("P", "Q"), pairs=1, deepest=1).df.agg(F.sum("pairs")).first()[0] == len(terms)


def test_cell_join_of_dense_clusters_compares_few_points(frame):
    from whence.operators.cells import cell_join

    a, b = numbered(crowd(5, 3000, (0.0, 0.0), 0.02)), numbered(crowd(6, 3000, (0.05, 0.05), 0.02))
    fa, fb = points(frame, "A", a), points(frame, "B", b)
    f = cell_join(fa, fb, ("ax", "ay"), ("bx", "by"), 1.0, ("P", "Q"))
    rows = f.df.collect()  # the clusters lie in four and in one of the first cells
    assert sum(r["pairs"] for r in rows) == 9_000_000 and len(rows) <= 16
    g = cell_join(fa, fb, ("ax", "ay"), ("bx", "by"), 0.07, ("P", "Q"), pairs=64)
    want = sum(1 for p in a for q in b if ((p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2])) ** 0.5 <= 0.07)
    assert g.df.agg(F.sum("pairs")).first()[0] == want and g.df.count() < want / 5


def test_cell_join_after_a_deletion_and_of_nothing(frame, spark):
    from whence.operators.cells import cell_join
    from whence.operators.evaluate import delete_tokens

    a, b = numbered(crowd(7, 80, (0.0, 0.1), 0.05)), numbered(crowd(8, 80, (0.1, 0.2), 0.05))
    fa, fb = points(frame, "A", a), points(frame, "B", b)
    f = cell_join(fa, fb, ("ax", "ay"), ("bx", "by"), 0.2, ("P", "Q"), pairs=4)
    gone = spark.createDataFrame([(f"A{i}",) for i in range(0, 80, 3)], "token string")
    left = delete_tokens(f, gone)
    want = near_pairs([p for p in a if p[0] % 3], b, 0.2)
    assert sorted(tuple(r["m"]) for r in expand(left).terms.collect()) == want
    assert left.df.agg(F.sum("pairs")).first()[0] == len(want)
    none = cell_join(fa.filter("a < 0"), fb, ("ax", "ay"), ("bx", "by"), 0.2, ("P", "Q"))
    assert none.df.count() == 0 and expand(none).terms.count() == 0
