"""What must not grow with the data: broadcasts chosen by file size, levels of interval trees."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from whence.functions.aggregates import count
from whence.operators import ranges, semirings
from whence.operators.cells import cell_join
from whence.operators.grouping import group
from whence.operators.semirings import expand
from whence.operators.subquery import anti_join, any_compare, semi_join
from whence.sources.tokens import annotate_keys


def test_estimates_from_files_do_not_broadcast(spark, tmp_path):
    spark.range(200_000).select("id", F.concat(F.lit("T"), "id").alias("t")).write.parquet(f"{tmp_path}/a")
    rows = spark.read.parquet(f"{tmp_path}/a")
    many = rows.select("t", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("n")).select(F.concat_ws("|", "t", "n").alias("k"))
    other = spark.range(10_000_000).select(F.col("id").cast("string").alias("j"))
    plan = other.join(many, F.col("j") == F.col("k"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("join", ["exists", "not_exists"])
def test_levels_follow_the_rows_of_a_key(spark, frame, monkeypatch, join):
    rows = [(i, i % 16, i * 1_000_003, (i * 7919) % 128 * 1_000_003) for i in range(128)]  # 8 of a key, far apart
    a, b = frame("A", "a int, k int, x long, u long", rows), frame("B", "b int, j int, y long, v long", rows)
    counts = {}

    def counted(df, name):
        counts[name] = df.count()
        return df

    monkeypatch.setattr(ranges, "stored", counted)
    tests = [("x", ">", "y"), ("u", "<", "v")]
    f = semi_join(a, b, [("k", "j")], "E", tests) if join == "exists" else anti_join(a, b, [("k", "j")], tests)
    found = {o[0] for o in rows for i in rows if o[1] == i[1] and o[2] > i[2] and o[3] < i[3]}
    got = {r["a"] for r in f.df.collect()}
    assert got == (found if join == "exists" else {o[0] for o in rows} - found)
    assert counts["filed"] <= 128 * 4 and counts["asked"] <= 128 * 4  # 28 bits of values


def test_count_over_one_key_spreads_its_rows(spark):
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(least)
    spark.conf.set(least, "16k")  # else rows this few are one task anyway
    try:
        rows = spark.range(100_000).select(F.col("id").alias("l"), F.lit(0.0).alias("z"))
        f = annotate_keys(rows, "L", ["l"]).count_over(["z"], "n").df.withColumn("p", F.spark_partition_id())
        sizes = f.groupBy("p", "n").count().collect()
    finally:
        spark.conf.set(least, before)
    assert {r["n"] for r in sizes} == {100_000} and sum(r["count"] for r in sizes) == 100_000
    assert max(r["count"] for r in sizes) < 60_000


@pytest.mark.parametrize("op", ["<", "<=", ">", ">=", "<>"])
def test_levels_of_one_comparison_follow_the_rows_of_a_key(spark, frame, op):
    holds = {"<": int.__lt__, "<=": int.__le__, ">": int.__gt__, ">=": int.__ge__, "<>": int.__ne__}[op]
    rows = [(i, i % 16, (i * 7919) % 128 * 1_000_003 - 2**26) for i in range(128)]  # 8 of a key, far apart, of 28 bits
    rows += [(128, 16, 5), (129, 16, 6), (130, 16, 2**40), (131, 17, 5)]
    a, b = frame("A", "a int, k int, x long", rows), frame("B", "b int, j int, y long", [r for r in rows if r[2] < 2**40])
    f = any_compare(a, "x", op, b, "y", "E", [("k", "j")])
    want = {(f"E[{k}|{x}]", f"B{j}") for _, k, x in rows for j, l, y in rows if k == l and y < 2**40 and holds(x, y)}
    got = [(r["out"], *r["m"], r["c"]) for r in expand(f, "E").terms.collect()]
    assert sorted(got) == sorted((*w, 1) for w in want)


@pytest.mark.parametrize("op", ["<", ">=", "<>"])
def test_one_comparison_has_few_levels_for_few_values(spark, op):
    rows = spark.createDataFrame([(str(i % 16), (i * 7919) % 128 * 1_000_003) for i in range(128)], "__key string, v long")  # 8 of a key, of 27 bits
    params, inside = rows.select(F.lit("E").alias("gate"), "__key", F.col("v").alias("__x0")), rows.withColumnRenamed("v", "__y0")
    asked, filed = ranges._met(params, inside, "__x0", "__y0", op)
    assert max(asked.count(), filed.count()) <= 128 * (9 if op == "<>" else 5)


def test_few_rows_that_make_many_terms_are_spread(spark, frame, monkeypatch):
    monkeypatch.setattr(semirings, "BLOCK", 1000)
    a, b = (frame(p, f"{c} int", [(i,) for i in range(300)]) for p, c in (("A", "a"), ("B", "b")))
    f = any_compare(a, "a", "<", b, "b", "E")
    made = expand(f, "E", spread=True).terms.withColumn("p", F.spark_partition_id())
    assert {(r["out"], *r["m"]) for r in made.collect()} == {(f"E[{i}]", f"B{j}") for i in range(300) for j in range(i + 1, 300)}
    sizes = [r["count"] for r in made.groupBy("p").count().collect()]
    assert sum(sizes) == 300 * 299 // 2 and max(sizes) < 0.6 * sum(sizes)


def test_texts_are_made_before_rows_and_derivations_meet(spark, frame):
    a, b = (frame(p, f"{c} int", [(i,) for i in range(30)]) for p, c in (("A", "a"), ("B", "b")))
    f = any_compare(a, "a", "<", b, "b", "E")
    alone, beside = expand(f, "E", spread=True, text=True).terms, expand(f, spread=True, text=True).terms  # gate tokens alone, and beside others
    plan = alone.select("out", "text")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joined = next(i for i, line in enumerate(plan) if "Join Inner" in line)
    assert any("array_join" in line and "AS __text" in line for line in plan[joined:])
    pairs = [(i, j) for i in range(30) for j in range(i + 1, 30)]
    assert sorted((r["out"], r["m"], r["text"], r["c"]) for r in alone.collect()) == sorted((f"E[{i}]", [f"B{j}"], f"B{j}", 1) for i, j in pairs)
    got = sorted((r["out"], r["m"], r["text"], r["c"]) for r in beside.collect())
    assert got == sorted((f"A{i} . E[{i}]", [f"A{i}", f"B{j}"], f"A{i} . B{j}", 1) for i, j in pairs)


def test_keys_with_few_rows_have_no_nodes(frame, monkeypatch):
    rows = [(i, i % 16, i * 7 % 100, i * 11 % 90) for i in range(160)]
    a, b = frame("A", "a int, k int, x int, u int", rows), frame("B", "b long, j long, y int, v int", rows)
    tests = [("x", ">", "y"), ("u", "<", "v")]
    want = sorted((f"E[{o[1]}|{o[2]}|{o[3]}]", f"B{i[0]}", 1) for o in rows for i in rows if o[1] == i[1] and o[2] > i[2] and o[3] < i[3])
    for most, nodes in ((100, 0), (99, 1)):  # 10 rows of a key on either side
        monkeypatch.setattr(ranges, "FEW", most)
        f = semi_join(a, b, [("k", "j")], "E", tests)
        assert len(f.gates) == 1 + nodes
        assert sorted((r["out"], *r["m"], r["c"]) for r in expand(f, "E").terms.collect()) == want


def test_rows_that_match_all_of_a_node_take_it_whole(frame, monkeypatch):
    monkeypatch.setattr(ranges, "FEW", 0)
    rows = [(i, 0, 1000 + i, i * 37 % 64) for i in range(64)]  # every x is above every y
    a, b = frame("A", "a int, k int, x int, u int", rows), frame("B", "b int, j int, y int, v int", [(i, 0, i, i * 29 % 64) for i in range(64)])
    f = semi_join(a, b, [("k", "j")], "E", [("x", ">", "y"), ("u", ">", "v")])
    assert f.gate("EN0").derivations.count() <= 64 * 4  # u and v have 7 bits, of which half are filed
    assert expand(f, "E").terms.count() == 64 * 63 // 2
    none = semi_join(a, b, [("k", "j")], "E", [("x", "<", "y"), ("u", ">", "v")])
    assert none.df.isEmpty() and none.gate("EN0").derivations.isEmpty()


def test_polynomials_are_added_up_before_they_are_expanded(frame, monkeypatch):
    rows = [(i, i % 2, i * 7 % 40, i * 11 % 30) for i in range(40)]
    a, b = frame("A", "a int, k int, x int, u int", rows), frame("B", "b int, j int, y int, v int", rows)
    for most in (0, 4096):
        monkeypatch.setattr(ranges, "FEW", most)
        f = semi_join(a, b, [("k", "j")], "E", [("x", ">", "y"), ("u", "<", "v")])
        want = Counter((str(o[1]), f"B{i[0]}") for o in rows for i in rows if o[1] == i[1] and o[2] > i[2] and o[3] < i[3])
        got = expand(f, "E", text=True, by=F.regexp_extract("out", r"E\[(\d+)", 1)).terms.collect()
        assert {(r["out"], r["text"]): r["c"] for r in got} == want and len(got) == len(want)


def test_products_of_cells_are_dealt_and_not_merged(spark, frame):
    rows = [(i, i % 2, i * 37 % 1000 / 1e4, i * 91 % 1000 / 1e4) for i in range(600)]
    f = frame("V", "i int, s int, x double, y double", rows)
    left, right = f.filter("s = 0").rename({"x": "ax", "y": "ay"}), f.filter("s = 1")  # one table, no point on both sides
    g = cell_join(left, right, ("ax", "ay"), ("x", "y"), 1.0, ("P", "Q"))
    assert g.origin.flat and g.origin.unique and g.df.count() == 1
    made = expand(g, packed=True).terms
    assert "HashAggregate(keys=[out" not in made._jdf.queryExecution().executedPlan().toString()
    made = made.withColumn("p", F.spark_partition_id())
    want = {tuple(sorted((f"V{i}", f"V{j}"))): 1 for i in range(0, 600, 2) for j in range(1, 600, 2)}
    assert {tuple(r["m"]): r["c"] for r in made.collect()} == want
    sizes = [r["count"] for r in made.groupBy("p").count().collect()]
    assert sum(sizes) == 300 * 300 and max(sizes) < 0.6 * sum(sizes)


def test_blocks_of_cells_are_dealt_once_and_pairs_of_points_made_once(frame):
    rows = [(i, i % 2, i * 37 % 1000 / 1e3, i * 91 % 1000 / 1e3) for i in range(200)]
    f = frame("V", "i int, s int, x double, y double", rows)
    left, right = f.filter("s = 0").rename({"x": "ax", "y": "ay"}), f.filter("s = 1")
    g = cell_join(left, right, ("ax", "ay"), ("x", "y"), 0.6, ("P", "Q"), pairs=16)
    made = expand(g, packed=True).terms
    plan = made._jdf.queryExecution().optimizedPlan()

    def nodes(p):
        children = p.children()
        return [p, *[n for i in range(children.size()) for n in nodes(children.apply(i))]]

    dealt = [n.output().mkString(" ") for n in nodes(plan) if n.nodeName() == "RepartitionByExpression"]
    assert any("__b0" in d for d in dealt) and not any("__b0" in d and "__b1" in d for d in dealt)
    assert sum("SQRT" in n.simpleString(10_000) for n in nodes(plan)) == 1
    near = lambda p, q: ((p[2] - q[2]) * (p[2] - q[2]) + (p[3] - q[3]) * (p[3] - q[3])) ** 0.5 <= 0.6
    want = sorted(tuple(sorted((f"V{p[0]}", f"V{q[0]}"))) for p in rows for q in rows if p[1] == 0 and q[1] == 1 and near(p, q))
    assert sorted(tuple(r["m"]) for r in made.collect()) == want
    assert g.df.filter("level is null").count() > 0 and g.df.filter("level is not null").count() > 0


def test_points_on_both_sides_are_still_merged(frame):
    rows = [(i, i * 37 % 100 / 1e3, i * 91 % 100 / 1e3) for i in range(40)]
    f = frame("V", "i int, x double, y double", rows)
    for r, most in ((1.0, 1), (0.04, 16)):
        g = cell_join(f.rename({"x": "ax", "y": "ay"}), f.filter("i < 30"), ("ax", "ay"), ("x", "y"), r, ("P", "Q"), pairs=most)
        assert not g.origin.flat
        plain, packed = (Counter({(r["out"], *r["m"]): r["c"] for r in expand(g, packed=p).terms.collect()}) for p in (False, True))
        near = lambda p, q: ((p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2])) ** 0.5 <= r
        pairs = Counter(tuple(sorted((f"V{p[0]}", f"V{q[0]}"))) for p in rows for q in rows[:30] if near(p, q))
        assert plain == packed and {k[1:] for k in packed} == set(pairs)
        if r == 1.0:  # all in one row: two points on both sides make a term twice
            assert Counter({k[1:]: c for k, c in packed.items()}) == pairs and 2 in pairs.values()


def test_packed_expansion_is_the_expansion(frame, monkeypatch):
    monkeypatch.setattr(semirings, "PACKED", 3)
    a, b = (frame(p, f"{c} int, k{c} int", [(i, i % 4) for i in range(50)]) for p, c in (("A", "a"), ("B", "b")))
    twice = a.union_all(a)  # its derivations repeat
    for one in (a, twice):
        g, h = group(one, ["ka"], "G", {"n": count()}), group(b.filter("kb < 3"), ["kb"], "H", {"o": count()})
        inner, outer = g.join(h, [("ka", "kb")]), g.join(h, [("ka", "kb")], "left")
        for f in (g, inner, outer, group(inner, ["n"], "I", {"p": count()}), group(inner, [], "J").cross_join(b)):
            plain, packed = (sorted((r["out"], *r["m"], r["c"]) for r in expand(f, packed=p).terms.collect()) for p in (False, True))
            assert plain == packed and plain
