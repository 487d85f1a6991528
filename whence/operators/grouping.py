"""Grouping, distinct, union and HAVING with provenance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from whence.functions import monomials as mono
from whence.functions.aggregates import Agg, derivations
from whence.functions.monomials import COND, PROV
from whence.operators.frame import Gate, Inputs, ProvFrame, Tensors, held_name

MODES = ("resolved", "symbolic")


def check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")


def group(
    frame: ProvFrame,
    keys: Sequence[str],
    name: str,
    aggs: dict[str, Agg] | None = None,
    *,
    delta: bool | None = None,
    mode: str = "resolved",
) -> ProvFrame:
    """GROUP BY keys; the group's annotation is the gate token ``name[key]``.

    Values come from an ordinary Spark aggregation, the derivations from a narrow
    projection of the input, so a hot group is never gathered anywhere.  Groups with
    aggregates are δ-gates, groups without are plain sums.  In symbolic mode the
    aggregate columns hold the name of their tensor instead of a value.
    """
    check_mode(mode)
    aggs = aggs or {}
    if frame.conds and mode == "resolved" and aggs:
        raise ValueError("the input carries symbolic conditions: resolve them first or group in symbolic mode")
    if any(g.name == name for g in frame.gates):
        raise ValueError(f"gate name {name!r} is taken")
    token = mono.gate_token(name, keys, dict(frame.df.dtypes))

    tensors = {a: agg.tensor() for a, agg in aggs.items()}
    tensors = {a: t for a, t in tensors.items() if t is not None}
    hidden = [COND] if frame.conds else []
    inputs, settled = None, frame.settled
    if tensors and frame.tensor_columns:  # aggregates of aggregates: these are made again when those change
        inputs = Inputs(held_name(), frame.tensor_columns, frame.derived, tensors)
        hidden.append(F.struct(*frame.columns).alias(inputs.held))
    if tensors and frame.frozen:
        settled = settled | {"an aggregate of columns that can't be computed again"}
    if frame.filters:
        settled = settled | {"a group of rows that a filter on an aggregate chose"}
    members = frame.df.select(
        token.alias("gate"), PROV, *hidden, *[t.alias(f"t_{a}") for a, t in tensors.items()]
    )
    gate = Gate(
        name,
        members,
        {a: aggs[a].folds for a in tensors},
        bool(aggs) if delta is None else delta,
        bool(keys),
        dict(frame.holds),
        frame.width,
        frame.conds,
        frame.origin,
        inputs=inputs,
    )

    if mode == "symbolic":
        rows = frame.df.select(*keys).distinct() if keys else frame.df.agg(F.count(F.lit(1)).alias("__n")).drop("__n")
        rows = rows.withColumns({a: F.concat(token, F.lit(f".{a}")) for a in tensors})
        columns: dict[str, tuple[tuple[str, str], ...]] = {}
    else:
        values = [agg.value().alias(a) for a, agg in aggs.items()]
        if values:
            rows = frame.df.groupBy(*keys).agg(*values)
        else:
            rows = frame.df.select(*keys).distinct()
        columns = {a: ((name, a),) for a in tensors}
    return ProvFrame(
        rows.withColumn(PROV, F.array(token)),
        (*frame.gates, gate),
        {name: (1, 1)},
        frame.width,
        (),
        columns,
        frame.origin.grouped(name),
        name,
        settled=settled,
    )


def distinct(frame: ProvFrame, name: str) -> ProvFrame:
    """SELECT DISTINCT: the annotations of equal rows are summed."""
    return group(frame, frame.columns, name)


def union(frames: Sequence[ProvFrame], name: str) -> ProvFrame:
    """UNION: all branches together, then distinct."""
    return distinct(reduce(ProvFrame.union_all, frames), name)


def self_join(frame: ProvFrame, keys: Sequence[str], name: str) -> ProvFrame:
    """Join of a table with itself on equal keys, in factored form.

    A key with n rows stands for its n² ordered pairs as ``name[key] . name[key]`` with
    their number in ``pairs``; no pair is formed.  Expanding the two tokens lists them.
    """
    g = group(frame, keys, name, {"members": derivations()}, delta=False)
    df = g.df.withColumn("pairs", F.col("members") * F.col("members"))
    df = df.withColumn(PROV, F.concat(PROV, PROV))
    squared = replace(g.origin, flat=False)
    return ProvFrame(df, g.gates, {name: (2, 2)}, 2 * frame.width, origin=squared, settled=g.settled | {"a number of pairs"})


def having(frame: ProvFrame, alias: str, op: str, value, mode: str = "resolved") -> ProvFrame:
    """Keep the groups whose aggregate satisfies ``alias op value``.

    Resolved mode filters on the value; a deletion decides all groups again.  Symbolic mode keeps every group and appends
    the condition ``[gate.alias op 1⊗value]``, to be decided by ``resolve``.
    """
    check_mode(mode)
    value = value if isinstance(value, Column) else F.lit(value)
    if mode == "resolved":
        return frame.filter(mono.compare(F.col(alias), op, value))
    gate = next(g for g in reversed(frame.gates) if alias in g.tensors and g.name in frame.holds)
    condition = mono.condition(mono.gate_ref(gate.name), alias, op, value)
    return with_condition(frame, condition, ((gate.name, alias),))


def with_condition(frame: ProvFrame, cond: Column, left: Tensors, right: Tensors = ()) -> ProvFrame:
    """Append a condition between one of the tensors ``left`` and a value or one of ``right``."""
    one = F.array(cond).cast(mono.COND_TYPE)
    column = F.concat(F.col(COND), one) if frame.conds else one
    conds = (*frame.conds, (frozenset(left), frozenset(right)))
    full = None if frame.full is None else frame.full.withColumn(COND, column)
    return replace(frame, df=frame.df.withColumn(COND, column), full=full, conds=conds)
