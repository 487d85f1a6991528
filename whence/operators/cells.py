"""Distance join for points of uneven density: crowded cells near each other stay one factored row."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.functions import monomials as mono
from whence.functions.aggregates import count
from whence.functions.monomials import PROV
from whence.operators.frame import Gate, Origin, ProvFrame, distinct_keys
from whence.operators.points import distance
from whence.session import stored

#: Pairs of points that two cells may have to be compared point by point; halvings of the first cells.
PAIRS, DEEPEST = 4096, 30

_WHOLE, _CHECK, _SPLIT = "whole", "check", "split"


def cell_join(
    left: ProvFrame,
    right: ProvFrame,
    left_xy: tuple[str, str],
    right_xy: tuple[str, str],
    r: float,
    names: tuple[str, str],
    pairs: int = PAIRS,
    deepest: int = DEEPEST,
) -> ProvFrame:
    """All pairs at most ``r`` apart, without listing those of crowded places.

    Points are counted in a quadtree of cells, level by level; only pairs of cells that are still open are cut
    further.  Two cells whose points all are within ``r`` of each other give one row, annotated ``A[cell] . B[cell]``
    with ``pairs`` = points here times points there; the cells are gates of their points.  Two cells that are apart
    give none, and two with at most ``pairs`` pairs are compared point by point, one row each.  Cells are judged by
    the box of the points in them, in the arithmetic of ``distance``, so the rows expand to exactly the pairs of
    ``distance_join``; places where points coincide are decided at once.

    Columns: ``level`` and the cells' places (NULL for pairs of points), ``left_points``, ``right_points``, ``pairs``.
    Points with NULL, NaN or infinite coordinates have no pairs.  Open cells are a table in the shared folder at each level,
    and all that were decided are another.
    """
    if not r > 0:
        raise ValueError("the distance must be positive")
    if left.conds or right.conds:
        raise ValueError("the input carries symbolic conditions: resolve them first")
    a, b = _placed(left, left_xy, r, "a"), _placed(right, right_xy, r, "b")
    levels: list[DataFrame] = []
    open_pairs = _neighbours(_counted(a, 0, "a"), _counted(b, 0, "b"))
    for level in range(deepest + 1):
        judged = stored(_judged(open_pairs, r, pairs, level == deepest), "cells")
        levels.append(judged.withColumn("level", F.lit(level)))
        split = judged.filter(F.col("state") == _SPLIT).select("ax", "ay", "bx", "by")
        if split.isEmpty():
            break
        open_pairs = _children(_children(split, _counted(a, level + 1, "a"), "a"), _counted(b, level + 1, "b"), "b")

    gates, holds = left._merge(right)
    if taken := {g.name for g in gates} & set(names) or len(set(names)) < 2:
        raise ValueError(f"gate names {names} are taken or equal: {taken}")
    # one table of all levels: a join of its own for each would be dealt by itself, and few of them have much to do
    decided = stored(reduce(DataFrame.unionAll, levels).filter(F.col("state") != _SPLIT), "decided")
    whole, check = decided.filter(F.col("state") == _WHOLE), decided.filter(F.col("state") == _CHECK)
    sides = ((left, a, "a", names[0]), (right, b, "b", names[1]))
    new = [_cell_gate(f, points, p, name, whole, len(levels)) for f, points, p, name in sides]
    rows = [_factored(whole, names), _compared(check, a, b, len(levels), r)]
    held = {g: (0, left.holds.get(g, (0, 0))[1] + right.holds.get(g, (0, 0))[1]) for g in {**left.holds, **right.holds}}
    both = _origin(left, right, a, b)
    origin = both.times_gate(names[0], left.origin).times_gate(names[1], right.origin)
    product = F.col("left_points") * F.col("right_points")
    rows = [df.withColumn("pairs", product) for df in rows]
    df = rows[0].unionAll(rows[1])
    return ProvFrame(
        df,
        (*gates, *new),
        {**holds, **held, names[0]: (0, 1), names[1]: (0, 1)},
        left.width + right.width,
        (),
        {"left_points": ((names[0], "n"),), "right_points": ((names[1], "n"),)},
        # a pair stands once, either in a row of its own or below one pair of cells
        Origin(origin.stored, origin.base, both.unique, both.flat),
        derived=(("pairs", product),),
        settled=left.settled | right.settled | ({"a distance join of rows that a filter on an aggregate chose"} if left.filters or right.filters else set()),
        apart=None if left.holds or right.holds else (df, *rows),
    )


def _origin(left: ProvFrame, right: ProvFrame, a: DataFrame, b: DataFrame) -> Origin:
    """Two sides of one table are like two tables if no token is on both; that is looked up, at the cost of the points and not of the pairs."""
    one, other, both = left.origin, right.origin, left.origin.with_(right.origin)
    if left.holds or right.holds or both.flat or not (one.unique and other.unique and one.flat and other.flat):
        return both
    tokens = [points.select(F.explode(f"{p}prov").alias(f"__{p}")) for points, p in ((a, "a"), (b, "b"))]
    shared = tokens[0].join(tokens[1], F.col("__a") == F.col("__b"), "left_semi")
    return replace(both, unique=True, flat=True) if shared.isEmpty() else both


def _placed(frame: ProvFrame, xy: tuple[str, str], r: float, p: str) -> DataFrame:
    """(prov, place, place in units of the first cells); these are a little wider than r, so rounding can't skip one."""
    x, y = (F.col(c).cast("double") for c in xy)
    df = frame.df.select(F.col(PROV).alias(f"{p}prov"), x.alias(f"{p}1"), y.alias(f"{p}2"))
    df = df.filter((F.abs(f"{p}1") < F.lit(float("inf"))) & (F.abs(f"{p}2") < F.lit(float("inf"))))
    return df.withColumns({f"{p}u": F.col(f"{p}1") / F.lit(r * 1.001), f"{p}v": F.col(f"{p}2") / F.lit(r * 1.001)})


def _cell(p: str, level: int) -> tuple[Column, Column]:
    """Scaling by a power of two is exact, so each cell lies in one of the level above."""
    x, y = (F.floor(F.col(p + c) * F.lit(float(1 << level))).cast("long") for c in "uv")
    return x.alias(f"{p}x"), y.alias(f"{p}y")


def _counted(points: DataFrame, level: int, p: str) -> DataFrame:
    """Cells with their number of points and the box of these; counted before the shuffle."""
    box = [g(f"{p}{i}").alias(f"{p}{i}{e}") for i in (1, 2) for g, e in ((F.min, "lo"), (F.max, "hi"))]
    return points.select("*", *_cell(p, level)).groupBy(f"{p}x", f"{p}y").agg(F.count(F.lit(1)).alias(f"{p}n"), *box)


def _neighbours(a: DataFrame, b: DataFrame) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = b.withColumn("step", F.explode(steps))
    return a.join(b, (F.col("ax") == F.col("bx") + F.col("step.i")) & (F.col("ay") == F.col("by") + F.col("step.j"))).drop("step")


def _children(split: DataFrame, cells: DataFrame, p: str) -> DataFrame:
    """Every open pair with the cells one level below on one side."""
    up = cells.withColumns({"__x": F.floor(F.col(f"{p}x") / 2).cast("long"), "__y": F.floor(F.col(f"{p}y") / 2).cast("long")})
    above = split.withColumnsRenamed({f"{p}x": "__px", f"{p}y": "__py"})
    return above.join(up, (F.col("__px") == F.col("__x")) & (F.col("__py") == F.col("__y"))).drop("__x", "__y", "__px", "__py")


def _judged(pairs: DataFrame, r: float, most: int, last: bool) -> DataFrame:
    """(ax, ay, an, bx, by, bn, state) of pairs of cells that may hold pairs of points."""
    far, near = [], []
    for i in (1, 2):
        lo, hi = F.col(f"a{i}lo") - F.col(f"b{i}hi"), F.col(f"b{i}lo") - F.col(f"a{i}hi")
        near.append(F.greatest(F.lit(0.0), lo, hi))
        far.append(F.greatest(F.col(f"a{i}hi") - F.col(f"b{i}lo"), F.col(f"b{i}hi") - F.col(f"a{i}lo")))
    size = lambda d: F.sqrt(d[0] * d[0] + d[1] * d[1])
    few = F.lit(last) | (F.col("an") * F.col("bn") <= most)
    state = F.when(size(far) <= r, _WHOLE).when(few, _CHECK).otherwise(_SPLIT)
    return pairs.filter(size(near) <= r).select("ax", "ay", "an", "bx", "by", "bn", state.alias("state"))


def _everywhere(points: DataFrame, levels: int, p: str) -> DataFrame:
    """Every point with its cell ``at`` of each level."""
    cells = [F.struct(F.lit(i).alias("level"), *[c.alias(x) for x, c in zip("xy", _cell(p, i))]) for i in range(levels)]
    return points.withColumn("at", F.explode(F.array(*cells)))


def _place(p: str) -> list[Column]:
    return [F.col("level"), F.col(f"{p}x"), F.col(f"{p}y")]


def _cell_gate(frame: ProvFrame, points: DataFrame, p: str, name: str, whole: DataFrame, levels: int) -> Gate:
    """The points of every cell that stands in a factored row."""
    n = count()
    used = distinct_keys(whole.select(mono.gate_token(name, _place(p)).alias("__w")), "__w")
    token = mono.gate_token(name, [F.col("at.level"), F.col("at.x"), F.col("at.y")])
    members = _everywhere(points, levels, p).select(token.alias("gate"), F.col(f"{p}prov").alias(PROV))
    members = members.join(used, F.col("gate") == F.col("__w"), "left_semi").withColumn("t_n", n.tensor())
    return Gate(name, members, {"n": n.folds}, False, True, dict(frame.holds), frame.width, (), frame.origin)


def _factored(whole: DataFrame, names: tuple[str, str]) -> DataFrame:
    tokens = F.array(*[mono.gate_token(name, _place(p)) for name, p in zip(names, "ab")])
    return whole.select("level", "ax", "ay", "bx", "by", F.col("an").alias("left_points"), F.col("bn").alias("right_points"), tokens.alias(PROV))


def _compared(cells: DataFrame, a: DataFrame, b: DataFrame, levels: int, r: float) -> DataFrame:
    """Pairs of points of cells that are few enough to be compared."""
    df = cells.select("level", "ax", "ay", "bx", "by")
    for points, p in ((a, "a"), (b, "b")):
        points = _everywhere(points, levels, p).select(f"{p}prov", f"{p}1", f"{p}2", "at")
        same = [mine == F.col(f"at.{c}") for mine, c in zip(_place(p), ("level", "x", "y"))]
        df = df.join(points, same[0] & same[1] & same[2]).drop("at")
    df = df.filter(distance(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2")) <= r)
    none, one = F.lit(None).cast("long"), F.lit(1).cast("long")
    places = [none.alias(c) for c in ("ax", "ay", "bx", "by")]
    return df.select(
        F.lit(None).cast("int").alias("level"), *places, one.alias("left_points"), one.alias("right_points"),
        F.concat("aprov", "bprov").alias(PROV),
    )
