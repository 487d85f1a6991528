"""Point queries; the points are the first two coordinates of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from whence.functions.aggregates import count, sum_
from whence.operators.cells import cell_join
from whence.operators.frame import ProvFrame
from whence.operators.grouping import group
from whence.operators.points import (
    collapse,
    distance_join,
    equal_points,
    in_box,
    nearest,
    place_join,
    within_distance,
)
from whence.operators.semirings import expand
from whence.plans.base import Tables, circuit_sql, gate, prod, query, result, with_

BOX = (-0.1, -0.05, 0.1, 0.2)
IN_BOX = "x BETWEEN -0.1::DOUBLE AND 0.1::DOUBLE AND y BETWEEN -0.05::DOUBLE AND 0.2::DOUBLE"


def _dist(a: str, b: str, c: str, d: str) -> str:
    a, b, c, d = (f"CAST({k} AS DOUBLE)" for k in (a, b, c, d))
    return f"sqrt(({a} - {c}) * ({a} - {c}) + ({b} - {d}) * ({b} - {d}))"


AT = _dist("x", "y", "0.05::DOUBLE", "0.02::DOUBLE")
query("points_in_box", with_(body=f"SELECT vec_id, label, vt AS how FROM v WHERE {IN_BOX}"))(
    lambda t: result(in_box(t.points, "x", "y", BOX).select("vec_id", "label"))
)
query("points_in_box_count", with_(body=f"SELECT count(*) AS n, 'BOX[]' AS how FROM v WHERE {IN_BOX}"))(
    lambda t: result(group(in_box(t.points, "x", "y", BOX), [], "BOX", {"n": count()}))
)
query("points_within_distance", with_(body=f"SELECT vec_id, label, vt AS how FROM v WHERE {AT} < 0.1"))(
    lambda t: result(within_distance(t.points, "x", "y", 0.05, 0.02, 0.1).select("vec_id", "label"))
)
query(
    "points_nearest", with_(body=f"SELECT vec_id, {AT} AS dist, vt AS how FROM v ORDER BY dist, vec_id LIMIT 1")
)(lambda t: result(nearest(t.points, "x", "y", 0.05, 0.02, 1, ["vec_id"]).select("vec_id", "dist")))
query(
    "points_nearest_in_box",
    with_(body=f"""SELECT vec_id, {AT} AS dist, vt AS how FROM v WHERE {IN_BOX} AND {AT} < 0.1 AND label = 3
    ORDER BY dist, vec_id LIMIT 5"""),
)(
    lambda t: result(
        nearest(
            within_distance(in_box(t.points, "x", "y", BOX), "x", "y", 0.05, 0.02, 0.1).filter("label = 3"),
            "x", "y", 0.05, 0.02, 5, ["vec_id"],
        ).select("vec_id", "dist")
    )
)

R = 0.03


def near_places(t: Tables) -> ProvFrame:
    left = t.points.filter("label = 0").rename({"x": "a_x", "y": "a_y"})
    return place_join(left, t.points.filter("label <> 0"), ("a_x", "a_y"), ("x", "y"), R, ("PA", "PB"))


PLACES_A = "pa AS (SELECT x, y, count(*) AS left_points FROM v WHERE label = 0 GROUP BY x, y)"
PLACES_B = "pb AS (SELECT x, y, count(*) AS right_points, sum(label) AS labels FROM v WHERE label <> 0 GROUP BY x, y)"
NEAR = f"""SELECT CAST(pa.x AS DOUBLE) AS a_x, CAST(pa.y AS DOUBLE) AS a_y, CAST(pb.x AS DOUBLE) AS x, CAST(pb.y AS DOUBLE) AS y,
  left_points, right_points, left_points * right_points AS pairs, {prod(gate('PA', 'pa.x', 'pa.y'), gate('PB', 'pb.x', 'pb.y'))} AS how
  FROM pa JOIN pb ON {_dist('pa.x', 'pa.y', 'pb.x', 'pb.y')} <= {R}::DOUBLE"""
query("points_distance_join", with_(PLACES_A, PLACES_B, body=NEAR))(lambda t: result(near_places(t)))
query("points_distance_join_top", with_(PLACES_A, PLACES_B, body=f"{NEAR} ORDER BY pa.x, pa.y, pb.x, pb.y LIMIT 10"))(
    lambda t: result(near_places(t).order_by("a_x", "a_y", "x", "y").limit(10))
)
query(
    "points_distance_join_count",
    with_(PLACES_A, PLACES_B, body=f"SELECT CAST(sum(pairs) AS BIGINT) AS n, 'NP[]' AS how FROM ({NEAR})"),
)(lambda t: result(group(near_places(t), [], "NP", {"n": sum_("pairs")})))


def near_average(t: Tables) -> ProvFrame:
    """Mean label around each point of class 0; coinciding neighbours are summed beforehand."""
    left = t.points.filter("label = 0").select("vec_id", F.col("x").alias("a_x"), F.col("y").alias("a_y"))
    right = collapse(
        t.points.filter("label <> 0"), ("x", "y"), "PB", {"labels": sum_("label"), "right_points": count()}
    )
    near = distance_join(left, right, ("a_x", "a_y"), ("x", "y"), R)
    g = group(near, ["vec_id"], "NEAR", {"labels": sum_("labels"), "n": sum_("right_points")})
    return g.with_columns(avg_label=F.col("labels").cast("double") / F.col("n"))


AVERAGED = f"FROM v JOIN pb ON {_dist('v.x', 'v.y', 'pb.x', 'pb.y')} <= {R}::DOUBLE WHERE label = 0"
query(
    "points_distance_join_avg",
    with_(PLACES_B, body=f"""SELECT vec_id, CAST(sum(labels) AS BIGINT) AS labels, CAST(sum(right_points) AS BIGINT) AS n,
    CAST(sum(labels) AS DOUBLE) / CAST(sum(right_points) AS BIGINT) AS avg_label, {gate('NEAR', 'vec_id')} AS how {AVERAGED} GROUP BY vec_id"""),
)(lambda t: result(near_average(t)))
query(
    "points_distance_join_circuit",
    circuit_sql(
        (gate("NEAR", "vec_id"), prod("vt", gate("PB", "pb.x", "pb.y")), AVERAGED),
        (gate("PB", "x", "y"), "vt", "FROM v WHERE label <> 0"),
        ctes=(PLACES_B,),
    ),
)(lambda t: near_average(t).circuit())


WIDE = 0.15


def near_cells(t: Tables) -> ProvFrame:
    """Points of class 0 with the others within a wide distance: crowded cells stay factored."""
    left = t.points.filter("label = 0").rename({"x": "a_x", "y": "a_y"})
    return cell_join(left, t.points.filter("label <> 0"), ("a_x", "a_y"), ("x", "y"), WIDE, ("CA", "CB"), pairs=64)


NEAR_CELLS = f"""FROM v a JOIN v b ON {_dist('a.x', 'a.y', 'b.x', 'b.y')} <= {WIDE}::DOUBLE
  WHERE a.label = 0 AND b.label <> 0"""
query("points_cells_count", with_(body=f"SELECT count(*) AS n, 'CN[]' AS how {NEAR_CELLS}"))(
    lambda t: result(group(near_cells(t), [], "CN", {"n": sum_("pairs")}))
)
query(
    "points_cells_expanded",
    with_(body=f"SELECT list_aggregate(list_sort([a.vt, b.vt]), 'string_agg', ' . ') AS monomial, CAST(1 AS BIGINT) AS coef {NEAR_CELLS}"),
)(lambda t: expand(near_cells(t), packed=True).terms.select(F.array_join("m", " . ").alias("monomial"), F.col("c").alias("coef")))


def whole_places(t: Tables) -> ProvFrame:
    """Points moved to the corner of their 0.05 grid cell, so that many coincide."""
    corner = lambda c: F.floor(F.col(c).cast("double") / F.lit(0.05))
    return t.points.select("vec_id", corner("x").alias("px"), corner("y").alias("py"))


PLACES = """FROM (SELECT *, CAST(floor(CAST(x AS DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS px,
  CAST(floor(CAST(y AS DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS py FROM v)"""
EQUAL = gate("EQ", "px", "py")
query(
    "points_equal",
    with_(body=f"""SELECT px, py, count(*) AS members, count(*) * count(*) AS pairs, {prod(EQUAL, EQUAL)} AS how
    {PLACES} GROUP BY px, py"""),
)(lambda t: result(equal_points(whole_places(t), ("px", "py"), "EQ")))
query("points_equal_circuit", circuit_sql((EQUAL, "vt", PLACES)))(
    lambda t: equal_points(whole_places(t), ("px", "py"), "EQ").circuit()
)
query(
    "points_equal_count",
    with_(body=f"SELECT CAST(sum(n) AS BIGINT) AS n, 'EN[]' AS how FROM (SELECT count(*) * count(*) AS n {PLACES} GROUP BY px, py)"),
)(lambda t: result(group(equal_points(whole_places(t), ("px", "py"), "EQ"), [], "EN", {"n": sum_("pairs")})))
query(
    "points_collapsed",
    with_(body=f"SELECT px, py, count(*) AS n, {gate('PLACE', 'px', 'py')} AS how {PLACES} GROUP BY px, py"),
)(lambda t: result(collapse(whole_places(t), ("px", "py"), "PLACE", {"n": count()})))
