"""Point geometry: box, distance, nearest, distance join, equal points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.functions.aggregates import derivations
from whence.operators.frame import ProvFrame
from whence.operators.grouping import group, self_join


def distance(x1, y1, x2, y2) -> Column:
    x1, y1, x2, y2 = ((c if isinstance(c, Column) else F.lit(c)).cast("double") for c in (x1, y1, x2, y2))
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def in_box(frame: ProvFrame, x: str, y: str, box: tuple[float, float, float, float]) -> ProvFrame:
    """Points inside (xmin, ymin, xmax, ymax); two range filters that reach the scan."""
    xmin, ymin, xmax, ymax = box
    return frame.filter(F.col(x).between(xmin, xmax) & F.col(y).between(ymin, ymax))


def within_distance(frame: ProvFrame, x: str, y: str, px: float, py: float, r: float) -> ProvFrame:
    box = in_box(frame, x, y, (px - r, py - r, px + r, py + r))
    return box.filter(distance(F.col(x), F.col(y), px, py) < r)


def nearest(frame: ProvFrame, x: str, y: str, px: float, py: float, k: int, tie: list[str]) -> ProvFrame:
    """The k nearest points; ``tie`` is a unique key that settles equal distances."""
    near = frame.with_columns(dist=distance(F.col(x), F.col(y), px, py))
    return near.order_by("dist", *tie).limit(k)


def distance_join(
    left: ProvFrame, right: ProvFrame, left_xy: tuple[str, str], right_xy: tuple[str, str], r: float
) -> ProvFrame:
    """Pairs at most ``r`` apart: equi-join on grid cells of side r, then exact check.

    Each right point is filed under its own cell and the eight around it.  Where many
    points may coincide use ``place_join``, or collapse one side first.
    """
    (lx, ly), (rx, ry) = left_xy, right_xy
    cell = lambda c: F.floor(F.col(c).cast("double") / F.lit(r)).cast("long")
    check = distance(F.col(lx), F.col(ly), F.col(rx), F.col(ry)) <= r

    def joining(mine: DataFrame, df: DataFrame) -> DataFrame:
        mine = mine.withColumns({"__cx": cell(lx), "__cy": cell(ly)})
        steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        df = df.withColumn("__s", F.explode(steps))
        df = df.withColumns({"__dx": cell(rx) + F.col("__s.i"), "__dy": cell(ry) + F.col("__s.j")}).drop("__s")
        cond = (F.col("__cx") == F.col("__dx")) & (F.col("__cy") == F.col("__dy")) & check
        return mine.join(df, cond).drop("__cx", "__cy", "__dx", "__dy")

    return left._joined(right, joining)


def collapse(frame: ProvFrame, xy: tuple[str, str], name: str, aggs=None) -> ProvFrame:
    """One row per distinct position, annotated by the sum of the points there.

    Joining collapsed sides keeps a place where very many points coincide one row.
    """
    return group(frame, list(xy), name, aggs, delta=False)


def equal_points(frame: ProvFrame, xy: tuple[str, str], name: str) -> ProvFrame:
    """Self-join on equal position, factored: one row per position with its number of pairs."""
    return self_join(frame, list(xy), name)


def place_join(
    left: ProvFrame,
    right: ProvFrame,
    left_xy: tuple[str, str],
    right_xy: tuple[str, str],
    r: float,
    names: tuple[str, str],
) -> ProvFrame:
    """Distance join of positions instead of points; ``pairs`` counts the pairs of points."""
    a = collapse(left, left_xy, names[0], {"left_points": derivations()})
    b = collapse(right, right_xy, names[1], {"right_points": derivations()})
    near = distance_join(a, b, left_xy, right_xy, r)
    return near.with_columns(pairs=F.col("left_points") * F.col("right_points"))
