import datetime
import operator
import random
from collections import Counter

import pytest
from helpers import hows, poly, polynomials
from pyspark.sql import functions as F

from whence.functions.aggregates import avg, count, max_, min_, sum_
from whence.operators import ranges
from whence.operators.subquery import (
    all_compare, anti_join, any_compare, in_, not_in, scalar_compare, semi_join,
)

OPS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def sql(op, a, b):
    return None if a is None or b is None else OPS[op](a, b)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    maybe = lambda lo, hi: None if rng.random() < 0.12 else rng.randint(lo, hi)
    outer = [(i, maybe(0, 6), maybe(-40, 40)) for i in range(80)]
    inner = [(i, maybe(0, 5), maybe(-40, 40)) for i in range(70)]
    return outer, inner


@pytest.fixture(scope="module")
def frames(data, frame):
    outer, inner = data
    return frame("A", "a int, k int, x int", outer), frame("B", "b int, j int, y int", inner)


def test_exists_once_per_outer_row(data, frames):
    outer, inner = data
    got = polynomials(semi_join(*frames, [("k", "j")], "E"), "a")
    want = {}
    for a, k, _ in outer:
        match = [b for b, j, _ in inner if k is not None and j == k]
        if match:
            want[a] = poly(*[f"A{a} B{b}" for b in match])
    assert got == want


@pytest.mark.parametrize("op", ["<>", "<", "<=", ">", ">=", "="])
def test_exists_and_not_exists_with_residual(data, frames, op):
    outer, inner = data
    match = {a: [b for b, j, y in inner if sql("=", k, j) and sql(op, x, y)] for a, k, x in outer}
    f = semi_join(*frames, [("k", "j")], "E", ("x", op, "y"))
    assert polynomials(f, "a") == {a: poly(*[f"A{a} B{b}" for b in m]) for a, m in match.items() if m}
    f = anti_join(*frames, [("k", "j")], ("x", op, "y"))
    assert hows(f, "a") == {a: f"A{a}" for a, m in match.items() if not m}


@pytest.mark.parametrize("kind", ["int", "decimal", "date", "timestamp", "double", "string"])
@pytest.mark.parametrize("op", ["<", ">=", "<>"])
def test_any_for_each_type(frame, spark, kind, op):
    rng = random.Random(5)
    value = {
        "int": lambda n: n * 7919,
        "decimal": lambda n: n / 4,
        "date": lambda n: datetime.date(1970, 1, 1) + datetime.timedelta(days=n),
        "timestamp": lambda n: datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=n * 1001),
        "double": lambda n: n / 8,
        "string": lambda n: f"{n + 500}",
    }[kind]
    outer = [(i, value(rng.randint(-50, 50))) for i in range(25)]
    inner = [(i, value(rng.randint(-30, 30))) for i in range(20)]
    base = {"decimal": "double"}.get(kind, kind)
    a, b = frame("A", f"a int, x {base}", outer), frame("B", f"b int, y {base}", inner)
    if kind == "decimal":
        a = a.with_columns(x=F.col("x").cast("decimal(10,2)"))
        b = b.with_columns(y=F.col("y").cast("decimal(12,4)"))
    got = polynomials(any_compare(a, "x", op, b, "y", "Q"), "a")
    want = {i: [j for j, y in inner if OPS[op](x, y)] for i, x in outer}
    assert got == {i: poly(*[f"A{i} B{j}" for j in m]) for i, m in want.items() if m}


@pytest.mark.parametrize("op", ["<", ">", "<>", "<=", ">="])
def test_ranges_at_the_ends_of_64_bits(frame, op):
    ends = [-(2**63), -(2**63) + 1, -1, 0, 1, 2**62, 2**63 - 1]
    a = frame("A", "a int, x bigint", list(enumerate(ends)))
    for inner in (ends, [5], [2**63 - 1, 2**63 - 2], [-7, -7, -8]):
        b = frame("B", "b int, y bigint", list(enumerate(inner)))
        got = polynomials(any_compare(a, "x", op, b, "y", "Q"), "a")
        want = {i: [j for j, y in enumerate(inner) if OPS[op](x, y)] for i, x in enumerate(ends)}
        assert got == {i: poly(*[f"A{i} B{j}" for j in m]) for i, m in want.items() if m}


def test_range_gates_stay_linear(frame):
    n = 400
    a = frame("A", "a int, x int", [(i, i) for i in range(n)])
    b = frame("B", "b int, y int", [(i, i) for i in range(n)])
    size = any_compare(a, "x", "<", b, "y", "Q").circuit().count()
    assert size < 25 * n < n * n / 2


@pytest.mark.parametrize("op", list(OPS))
def test_all_by_definition(data, frames, op):
    outer, inner = data
    got = hows(all_compare(*frames[:1], "x", op, frames[1], "y", "Q", [("k", "j")]), "a")
    want = {}
    for a, k, x in outer:
        ys = [y for _, j, y in inner if sql("=", k, j)]
        if all(sql(op, x, y) is True for y in ys):
            want[a] = f"A{a}" if not ys or op == "<>" else f"A{a} . Q[{k}]"
    assert got == want


def test_all_and_any_over_nothing(frames, frame):
    empty = frames[1].filter("b < 0")
    n = len(hows(frames[0], "a"))
    for op in OPS:
        assert len(hows(all_compare(frames[0], "x", op, empty, "y", "Q"), "a")) == n
        assert hows(any_compare(frames[0], "x", op, empty, "y", "Q"), "a") == {}


def test_in_ignores_duplicates(frame):
    a, b = frame("A", "a int, k int", [(1, 1), (2, 2)]), frame("B", "b int, j int", [(1, 1), (2, 1), (3, None)])
    f = in_(a, b, [("k", "j")], "I")
    assert polynomials(f, "a") == {1: poly("A1 B1", "A1 B2")}
    assert f.how().count() == 1


def test_not_in_with_nulls(data, frames, frame):
    outer, inner = data
    a, b = frames
    assert hows(not_in(a, b, "x", "y"), "a") == {}  # the list holds a NULL
    known = b.filter("y is not null")
    ys = {y for _, _, y in inner if y is not None}
    want = {i for i, _, x in outer if x is not None and x not in ys}
    assert set(hows(not_in(a, known, "x", "y"), "a")) == want
    assert len(hows(not_in(a, b.filter("b < 0"), "x", "y"), "a")) == len(outer)
    got = set(hows(not_in(a, b, "x", "y", [("k", "j")]), "a"))
    want = set()
    for i, k, x in outer:
        ys = [y for _, j, y in inner if sql("=", k, j)]
        if not ys or (x is not None and None not in ys and x not in ys):
            want.add(i)
    assert got == want


@pytest.mark.parametrize("op", list(OPS))
@pytest.mark.parametrize("kind", ["min", "max", "sum", "avg", "count"])
def test_scalar_compare(data, frames, op, kind):
    outer, inner = data
    agg = {"min": min_("y"), "max": max_("y"), "sum": sum_("y"), "avg": avg("y"), "count": count("y")}[kind]

    def fold(ys):
        ys = [y for y in ys if y is not None]
        if kind == "count":
            return len(ys)
        return None if not ys else {"min": min, "max": max, "sum": sum, "avg": lambda v: sum(v) / len(v)}[kind](ys)

    got = hows(scalar_compare(*frames[:1], "x", op, frames[1], agg, "Q"), "a")
    total = fold([y for _, _, y in inner])
    assert got == {a: f"A{a} . Q[]" for a, _, x in outer if sql(op, x, total)}
    got = hows(scalar_compare(frames[0], "x", op, frames[1], agg, "Q", [("k", "j")]), "a")
    want = {}
    for a, k, x in outer:
        ys = [y for _, j, y in inner if sql("=", k, j)]
        if sql(op, x, fold(ys)):
            want[a] = f"A{a} . Q[{k}]" if ys else f"A{a}"
    assert got == want


def test_scalar_or(data, frames):
    outer, inner = data
    f = scalar_compare(frames[0], "x", ">", frames[1], max_("y"), "Q", [("k", "j")], or_where=F.col("a") < 5)
    want = {}
    for a, k, x in outer:
        ys = [y for _, j, y in inner if sql("=", k, j) and y is not None]
        if ys and x is not None and x > max(ys):
            want[a] = f"A{a} . Q[{k}]"
        elif a < 5:
            want[a] = f"A{a}"
    assert hows(f, "a") == want


def test_row_comparison(data, frames):
    outer, inner = data
    f = any_compare(frames[0], ["k", "x"], "<", frames[1], ["j", "y"], "Q")
    rows = [(b, (j, y)) for b, j, y in inner if None not in (j, y)]
    want = {a: [b for b, r in rows if (k, x) < r] for a, k, x in outer if None not in (k, x)}
    got = polynomials(f, "a")
    assert got == {a: poly(*[f"A{a} B{b}" for b in m]) for a, m in want.items() if m}


def test_types_of_keys_must_agree(frames, frame):
    words = frame("W", "w int, t string", [(1, "1")])
    with pytest.raises(ValueError, match="cast"):
        semi_join(frames[0], words, [("k", "t")], "E")


def test_nested_subqueries_expand(frame):
    a = frame("A", "a int, k int", [(1, 1), (2, 2)])
    b = frame("B", "b int, j int, z int", [(1, 1, 7), (2, 1, 8), (3, 2, 9)])
    c = frame("C", "c int, w int", [(1, 7), (2, 7), (3, 8)])
    f = in_(a, in_(b, c, [("z", "w")], "I"), [("k", "j")], "O")
    assert polynomials(f, "a") == {1: poly("A1 B1 C1", "A1 B1 C2", "A1 B2 C3")}
    assert isinstance(polynomials(f, "a")[1], Counter)


# ---- several comparisons, groups of them, row values ----------------------------


@pytest.fixture(scope="module")
def wide(frame):
    rng = random.Random(23)
    maybe = lambda lo, hi: None if rng.random() < 0.15 else rng.randint(lo, hi)
    outer = [(i, maybe(0, 3), maybe(-9, 9), maybe(0, 12), maybe(0, 2)) for i in range(60)]
    inner = [(i, maybe(0, 3), maybe(-9, 9), maybe(0, 12), maybe(0, 2)) for i in range(50)]
    frames = frame("A", "a int, k int, x int, u double, m string", [(a, k, x, None if u is None else u / 2, None if m is None else str(m)) for a, k, x, u, m in outer]), frame(
        "B", "b int, j int, y int, v double, n string", [(b, j, y, None if v is None else v / 2, None if n is None else str(n)) for b, j, y, v, n in inner]
    )
    return outer, inner, frames


COLUMNS = {"k": 1, "x": 2, "u": 3, "m": 4, "j": 1, "y": 2, "v": 3, "n": 4}


def holds(o, i, triples):
    return all(sql(op, o[COLUMNS[x]], i[COLUMNS[y]]) for x, op, y in triples)


BOXES = {
    "two": ([("x", ">", "y"), ("u", "<", "v")], ()),
    "equal": ([("m", "=", "n"), ("u", "<=", "v")], ()),
    "three": ([("x", ">=", "y"), ("u", "<>", "v"), ("m", "<", "n")], ()),
    "or": ((), ([("x", ">", "y")], [("u", "<", "v")])),
    "or_groups": ([("x", "<>", "y")], ([("x", ">", "y"), ("u", "<", "v")], [("m", "=", "n")], [("u", ">=", "v"), ("m", ">", "n")])),
}


@pytest.mark.parametrize("case, keys", [("two", ()), ("equal", (("k", "j"),)), ("three", (("k", "j"),)), ("or", ()), ("or_groups", (("k", "j"),))])
def test_several_comparisons(wide, case, keys):
    outer, inner, frames = wide
    residual, either = BOXES[case]
    match = {
        o[0]: [i[0] for i in inner if holds(o, i, [(a, "=", b) for a, b in keys]) and holds(o, i, residual) and (not either or any(holds(o, i, g) for g in either))]
        for o in outer
    }
    f = semi_join(*frames, keys, "E", residual, either)
    assert polynomials(f, "a") == {a: poly(*[f"A{a} B{b}" for b in m]) for a, m in match.items() if m}
    f = anti_join(*frames, keys, residual, either)
    assert hows(f, "a") == {a: f"A{a}" for a, m in match.items() if not m}


@pytest.mark.parametrize("case, keys, few", [("two", (), 0), ("three", (("k", "j"),), 0), ("or_groups", (("k", "j"),), 150)])
def test_several_comparisons_by_trees_and_by_pairs(wide, monkeypatch, case, keys, few):
    outer, inner, frames = wide
    residual, either = BOXES[case]
    sizes = {k: sum(o[1] == k for o in outer) * sum(i[1] == k for i in inner) for k in range(4)}
    assert not few or min(sizes.values()) < few < max(sizes.values())
    match = {
        o[0]: [i[0] for i in inner if holds(o, i, [(a, "=", b) for a, b in keys]) and holds(o, i, residual) and (not either or any(holds(o, i, g) for g in either))]
        for o in outer
    }
    monkeypatch.setattr(ranges, "FEW", few)
    f = semi_join(*frames, keys, "E", residual, either)
    assert polynomials(f, "a") == {a: poly(*[f"A{a} B{b}" for b in m]) for a, m in match.items() if m}
    f = anti_join(*frames, keys, residual, either)
    assert hows(f, "a") == {a: f"A{a}" for a, m in match.items() if not m}


@pytest.mark.parametrize("side, keys", [("both", ()), ("both", (("k", "j"),)), ("inner", ()), ("none", (("k", "j"),))])
def test_not_in_several_columns(spark, frame, wide, keys, side):
    outer, inner, _ = wide
    if side in ("none", "outer"):
        inner = [r for r in inner if None not in r]
    if side in ("none", "inner"):
        outer = [r for r in outer if None not in r]
    inner = inner[:9]
    a = frame("A", "a int, k int, x int, u int, m int", outer)
    b = frame("B", "b int, j int, y int, v int, n int", inner)

    def equal(o, i):  # SQL: false if some column differs, unknown if none does and some is NULL
        parts = [sql("=", o[c], i[c]) for c in (2, 4)]
        return False if False in parts else None if None in parts else True

    want = {}
    for o in outer:
        rows = [i for i in inner if not keys or sql("=", o[1], i[1])]
        if all(equal(o, i) is False for i in rows):
            want[o[0]] = f"A{o[0]}"
    assert hows(not_in(a, b, ["x", "m"], ["y", "n"], keys), "a") == want
    assert len(hows(not_in(a, b.filter("b < 0"), ["x", "m"], ["y", "n"], keys), "a")) == len(outer)


@pytest.mark.parametrize("op", ["<", ">=", "="])
def test_row_values_against_aggregates_and_all(wide, frame, op):
    outer = [r for r in wide[0] if None not in r]
    inner = [r for r in wide[1] if None not in r]
    a = frame("A", "a int, k int, x int, u int, m int", outer)
    b = frame("B", "b int, j int, y int, v int, n int", inner)
    want, every = {}, set()
    for o in outer:
        rows = [i for i in inner if i[1] == o[1]]
        if rows and OPS[op]((o[2], o[3]), (min(i[2] for i in rows), max(i[3] for i in rows))):
            want[o[0]] = poly(*[f"A{o[0]} B{i[0]}" for i in rows])
        if all(OPS[op]((o[2], o[3]), (i[2], i[3])) for i in rows):
            every.add(o[0])
    f = scalar_compare(a, ["x", "u"], op, b, [min_("y"), max_("v")], "S", [("k", "j")])
    assert polynomials(f, "a") == want
    assert set(hows(all_compare(a, ["x", "u"], op, b, ["y", "v"], "L", [("k", "j")]), "a")) == every


AGGS = {"sum": (sum_, sum), "count": (count, len), "avg": (avg, lambda v: sum(v) / len(v)), "min": (min_, min), "max": (max_, max)}


@pytest.mark.parametrize("kind, keys", [("sum", ()), ("count", (("k", "j"),)), ("avg", (("k", "j"),)), ("min", ()), ("max", (("k", "j"),))])
def test_scalar_over_a_range(wide, frame, kind, keys):
    outer, inner, _ = wide
    a = frame("A", "a int, k int, x int, u int, m int", outer)
    b = frame("B", "b int, j int, y int, v int, n int", inner)
    make, fold = AGGS[kind]
    want = {}
    for o in outer:
        rows = [i for i in inner if sql(">", o[2], i[2]) and (not keys or sql("=", o[1], i[1]))]
        values = [i[3] for i in rows if i[3] is not None]
        value = fold(values) if values or kind == "count" else None
        if sql("<=", o[3], value):
            want[o[0]] = poly(*[f"A{o[0]} B{i[0]}" for i in rows]) if rows else poly(f"A{o[0]}")
    f = scalar_compare(a, "u", "<=", b, make("v"), "S", keys, residual=("x", ">", "y"))
    assert polynomials(f, "a") == want
