import random
from collections import Counter

import pytest
from helpers import polynomials
from pyspark.sql import functions as F

from whence import distinct, expand, group, union
from whence.functions.aggregates import count
from whence.operators import semirings
from whence.operators.semirings import Polynomials, forms


def make(spark, rows, delta=False):
    """Polynomials from {out: [monomial, ...]} with repeats as coefficients."""
    flat = Counter((out, tuple(sorted(m.split()))) for out, ms in rows.items() for m in ms)
    df = spark.createDataFrame([(o, list(m), c) for (o, m), c in flat.items()], "out string, m array<string>, c long")
    return Polynomials(df, delta)


def sets(df):
    return {(r["out"], tuple(r["m"])) for r in df.collect()}


def minimal(rows):
    out = set()
    for o, ms in rows.items():
        ws = {frozenset(m.split()) for m in ms}
        out |= {(o, tuple(sorted(w))) for w in ws if not any(v < w for v in ws)}
    return out


MIXED = {"r": ["a b", "a b", "a a", "a", "b c", "c b b", "c"], "s": ["a b c", "c d"]}


def test_each_form(spark):
    p = make(spark, MIXED)
    kinds = ("how", "boolean", "trio", "why", "posbool", "lineage")
    terms = lambda df, kind, out="r": {r["term"]: r["coef"] for r in df if (r["form"], r["out"]) == (kind, out)}
    rows = p.texts(*kinds).collect()
    assert terms(rows, "how") == {"a . b": 2, "a": 1, "a . a": 1, "b . b . c": 1, "b . c": 1, "c": 1}
    assert terms(rows, "how", "s") == {"a . b . c": 1, "c . d": 1}
    assert set(terms(rows, "boolean")) == set(terms(rows, "how")) and set(terms(rows, "boolean").values()) == {1}
    assert terms(rows, "trio") == {"a": 2, "a . b": 2, "b . c": 2, "c": 1}
    assert terms(rows, "why") == {"{a,b}": 1, "{a}": 1, "{b,c}": 1, "{c}": 1}
    assert terms(rows, "posbool") == {"a": 1, "c": 1} and set(terms(rows, "posbool", "s")) == {"(a ∧ b ∧ c)", "(c ∧ d)"}
    assert terms(rows, "lineage") == {"a": 1, "b": 1, "c": 1}
    for kind in kinds:  # alone as together
        assert sorted(map(tuple, p.texts(kind).collect())) == sorted(tuple(r) for r in rows if r["form"] == kind)
    assert {r["delta"] for r in make(spark, {"g": ["a", "b"]}, delta=True).texts().collect()} == {True}
    with pytest.raises(ValueError):
        p.texts("whether")


def test_texts_group_only_what_can_repeat(spark):
    p = make(spark, MIXED)
    plan = lambda *kinds: p.texts(*kinds)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan("how", "boolean")  # different terms stay different
    assert plan("how", "boolean", "trio", "why", "lineage").count("Aggregate") == 1
    rows = [tuple(r) for r in p.texts("how", "trio", "why", "lineage").collect()]
    assert len(rows) == len(set(rows)) and sum(r[1] == "trio" for r in rows) == sum(r[1] == "why" for r in rows) == 6


@pytest.mark.parametrize("seed", [0, 2, 10])
def test_absorption_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = {
        f"o{i}": [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 25))]
        for i in range(12)
    }
    assert sets(make(spark, rows).posbool()) == minimal(rows)


def test_absorption_of_wide_witnesses(spark):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(40)]
    rows = {}
    for i in range(4):
        base = [rng.sample(words, rng.randint(3, 14)) for _ in range(15)]
        grown = [b + rng.sample(words, rng.randint(0, 9)) for b in base for _ in range(3)]
        rows[f"o{i}"] = [" ".join(w) for w in base + grown]
    assert sets(make(spark, rows).posbool()) == minimal(rows)


def test_a_token_in_every_witness_brings_no_two_together(spark):
    """Few families of a shared token and an own one: without the second token, each family is all pairs."""
    rng = random.Random(9)
    big = [f"x f{i % 4} a{i} b{rng.randrange(500)}" for i in range(2000)]
    small = [f"x f{i % 4} c{i}" for i in range(2000)]
    rows = {"o": big + small + ["x f0 c0 d", "x f1"]}
    w = make(spark, rows).why()
    _, asking, filed = semirings._lookups(w)
    met = asking.join(filed, F.col("__k2") == F.col("__f2"))
    assert met.count() < 3000
    kept = [m for m in big + small if "f1" not in m.split()] + ["x f1"]
    assert sets(make(spark, rows).posbool()) == {("o", tuple(sorted(m.split()))) for m in kept}


def test_many_with_the_same_rarest_token_are_filed_under_two(spark):
    pairs = [f"x{i} y{j}" for i in range(40) for j in range(40)]
    rows = {"o": pairs[::2] + [f"{p} z{n}" for n, p in enumerate(pairs)], "p": [f"{p} z{n}" for n, p in enumerate(pairs)]}
    _, asking, filed = semirings._lookups(make(spark, {"o": pairs + [f"{p} z" for p in pairs]}).why())
    assert asking.join(filed, F.col("__k2") == F.col("__f2")).count() <= 2 * len(pairs)
    assert sets(make(spark, rows).posbool()) == minimal({"o": rows["o"]}) | {("p", tuple(m.split())) for m in rows["p"]}


def test_absorption_makes_the_terms_once(spark):
    m = F.when(F.col("id") % 3 == 0, F.array(F.col("id").cast("string"))).otherwise(F.array(F.lit("a"), F.col("id").cast("string")))
    p = Polynomials(spark.range(90).select(F.lit("o").alias("out"), m.alias("m"), F.lit(1).cast("long").alias("c")), flat=True)
    assert "Range" not in p.posbool()._jdf.queryExecution().optimizedPlan().toString()
    assert p.posbool().count() == 90
    _, asking, filed = semirings._lookups(p.why())
    assert filed.count() == 30 and asking.count() == 0  # nothing that is as wide as any other is filed


def test_large_rows_have_the_shape_of_small_ones(spark):
    rows = {"big": [f"t{i}" for i in range(1000)], "small": ["x", "y"]}
    got = make(spark, rows).texts().collect()
    assert sorted(r["term"] for r in got if r["out"] == "big") == sorted(rows["big"])
    assert sorted(r["term"] for r in got if r["out"] == "small") == ["x", "y"]


def test_forms_keep_the_result_columns(frame):
    f = group(frame("C", "c int, g string", [(1, "x"), (2, "x"), (3, "y")]), ["g"], "G", {"n": count()})
    got = {}
    for r in forms(f, ["how", "lineage", "posbool"]).collect():
        got.setdefault((r["g"], r["n"], r["form"], r["delta"]), set()).add(r["term"])
    assert got[("x", 2, "how", True)] == {"C1", "C2"} == got[("x", 2, "lineage", False)]
    assert got[("y", 1, "posbool", False)] == {"C3"}


@pytest.fixture
def three(frame):
    return [frame(p, f"{p.lower()} int, k int", [(i, i % 3) for i in range(1, n)]) for p, n in (("A", 7), ("B", 5), ("D", 4))]


def polys(f):
    return polynomials(f, f.columns[0])


def test_sum_and_product_laws(three):
    a, b, d = three
    ka, kb, kd = (f.select(F.col("k")) for f in three)
    assert polys(union([ka, kb], "U")) == polys(union([kb, ka], "U"))
    assert polys(union([union([ka, kb], "V"), kd], "U")) == polys(union([ka, kb, kd], "U"))
    bb, dd = b.rename({"k": "kb"}), d.rename({"k": "kd"})
    ab = distinct(a.join(bb, [("k", "kb")]).select("k"), "P")
    ba = distinct(bb.join(a, [("kb", "k")]).select("k"), "P")
    assert polys(ab) == polys(ba)
    # a (b + d) = a b + a d
    both = union([kb, kd], "S").rename({"k": "kb"})
    left = distinct(a.join(both, [("k", "kb")]).select("k"), "P")
    right = union([a.join(bb, [("k", "kb")]).select("k"), a.join(dd, [("k", "kd")]).select("k")], "P")
    assert polys(left) == polys(right)


def test_tokens_as_one_count_the_bag(three):
    a, b, _ = three
    j = a.join(b.rename({"k": "kb"}), [("k", "kb")]).select("k")
    sizes = {r["k"]: r["count"] for r in j.plain().groupBy("k").count().collect()}
    assert {k: sum(p.values()) for k, p in polys(distinct(j, "P")).items()} == sizes


def test_forms_commute_with_grouping(three):
    """Coarsening the sum equals the sum of the coarse parts."""
    a, b, _ = three
    left = a.join(b.rename({"k": "kb"}), [("k", "kb")]).select("k")
    whole = expand(union([left, a.select("k"), a.select("k")], "U"))
    by_hand = {}
    for f in (left, a.select("k"), a.select("k")):
        for k, p in polys(distinct(f, "U")).items():
            by_hand.setdefault(f"U[{k}]", Counter()).update({tuple(sorted(set(m))): c for m, c in p.items()})
    got = {}
    for r in whole.trio().collect():
        got.setdefault(r["out"], Counter())[tuple(r["m"])] = r["c"]
    assert got == by_hand
    assert sets(whole.why()) == {(o, m) for o, p in by_hand.items() for m in p}
    lin = {(r["out"], r["token"]) for r in whole.lineage().collect()}
    assert lin == {(o, t) for o, p in by_hand.items() for m in p for t in m}
