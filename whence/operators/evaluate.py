"""Evaluate tensors, conditions and polynomials again: valuations, deletions, what-if."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.functions import monomials as mono
from whence.functions.aggregates import evaluate
from whence.functions.monomials import COND, PROV
from whence.operators.frame import Conditions, Filter, Gate, ProvFrame, distinct_keys
from whence.session import stored


def gate_values(gate: Gate, aliases: Sequence[str] | None = None) -> DataFrame:
    """``(gate, <alias>...)``: tensors of the gate, all or those named, folded over its derivations."""
    aliases = list(gate.tensors) if aliases is None else aliases
    folds = [evaluate(gate.tensors[a], F.col(f"t_{a}")).alias(a) for a in aliases]
    keys = ["gate"] if gate.keyed else []
    values = gate.derivations.groupBy(*keys).agg(*folds)
    return values if gate.keyed else values.select(F.lit(f"{gate.name}[]").alias("gate"), *aliases)


def surviving(df: DataFrame, dead: DataFrame, width: int) -> DataFrame:
    """Rows whose monomial, of ``width`` tokens at most, holds none of the tokens in ``dead(token)``.

    Up to ``LOOKUPS`` tokens are looked up one after the other, without moving the rows where AQE finds the dead
    tokens small enough to broadcast; longer monomials are looked up by their tokens.
    """
    if width <= LOOKUPS:
        for i in range(width):
            df = df.join(dead.select(F.col("token").alias("__d")), F.get(PROV, F.lit(i)) == F.col("__d"), "left_anti")
        return df
    text = mono.monomial_text(PROV)
    hit = (
        df.select(text.alias("__m"), F.explode(PROV).alias("__t"))
        .join(dead.select(F.col("token").alias("__d")), F.col("__t") == F.col("__d"), "left_semi")
    )
    hit = distinct_keys(hit.select("__m"), "__m").withColumnRenamed("__m", "__hit")
    return df.withColumn("__m", text).join(hit, F.col("__m") == F.col("__hit"), "left_anti").drop("__m")


#: Tokens of a monomial that are looked up one by one.
LOOKUPS = 3


def _tokens(holds: Mapping[str, tuple[int, int]], width: int, gates: Mapping[str, Gate]) -> int:
    """The most tokens a monomial can have before it is expanded."""
    within = sum(high * max(1, gates[g].width) for g, (_, high) in holds.items() if g in gates)
    return sum(high for _, high in holds.values()) + max(0, width - within)


def delete_tokens(frame: ProvFrame, deleted: DataFrame) -> ProvFrame:
    """The frame as if the base rows in ``deleted(token)`` were gone.

    Derivations holding a deleted token fall away; a gate token that has lost all its
    derivations counts as deleted for the gates and rows above it, unless it stands for a
    COUNT.  Aggregate columns, aggregates of aggregates, and columns computed from them, are made again
    from what is left, and filters on them decide all rows again, also those they had left out.  What can't be decided
    again is refused: limits, ranks, counts over partitions, columns computed in ``select``, and groups or
    unions of rows that such a filter chose (symbolic mode keeps those decidable).  As everywhere, anti-joins carry
    the outer annotation alone, so the inner side's deletions don't bring rows back.

    Tokens lost at a gate that several others hold are a table in the shared folder, so the plan grows by
    one step for each gate.
    """
    if frame.frozen:
        raise ValueError(f"can't compute {sorted(frame.frozen)} again from the aggregates: leave them out or use with_columns")
    if frame.settled:
        raise ValueError(f"a deletion can't decide these again: {', '.join(sorted(frame.settled))}; delete before them, or use symbolic mode")
    base = deleted.select("token")
    lost: dict[str, DataFrame] = {}
    gates: dict[str, Gate] = {}
    dead = lambda holds: reduce(DataFrame.unionAll, [lost[g] for g in holds if g in lost], base)
    for g in frame.gates:
        left = surviving(g.derivations, dead(g.holds), _tokens(g.holds, g.width, gates))
        if g.inputs is not None:
            left = _inputs_again(left, g, gates)
        gates[g.name] = replace(g, derivations=left)
        users = [*[u.holds for u in frame.gates], frame.holds]
        held = sum(g.name in u for u in users)
        if g.keyed and not g.counting and held and not (held == 1 and _groups(frame, g)):
            alive = distinct_keys(left.select(F.col("gate").alias("token")), "token")
            gone = distinct_keys(g.derivations.select(F.col("gate").alias("token")), "token").join(alive, "token", "left_anti")
            lost[g.name] = stored(gone, "lost-tokens") if held > 1 or len(frame.gates) > 1 else gone
    width = _tokens(frame.holds, frame.width, gates)
    alive = lambda df: surviving(df, dead(frame.holds), width)
    top = frame.gate(frame.whole) if frame.whole else None
    if top is not None and _groups(frame, top):
        # the rows are the gate's groups: a group is left if its values are
        alive = lambda df: df
    if not frame.filters:
        return refold(replace(frame, df=alive(frame.df), gates=tuple(gates.values())), inner=top)
    full = df = alive(frame.full)
    for f in frame.filters:
        df = _decided(df, f, replace(frame, gates=tuple(gates.values())))
    df = df.drop(*[f.held for f in frame.filters])
    return refold(replace(frame, df=df, gates=tuple(gates.values()), full=full))


def _groups(frame: ProvFrame, gate: Gate) -> bool:
    """Are the rows the gate's groups, whose values are folded anyway?"""
    return frame.whole == gate.name and gate.keyed and not gate.counting and any(g == gate.name for ts in frame.tensor_columns.values() for g, _ in ts)


def _again(df: DataFrame, held: str, tensors, derived, frame: ProvFrame, rest: str) -> DataFrame:
    """The values held in a column, made again; the row itself is in ``rest``."""
    hidden = [c for c in (PROV, COND) if c in df.columns]
    flat = df.select(F.struct(*[c for c in df.columns]).alias(rest), *hidden, F.col(f"{held}.*"))
    return refold(replace(frame, df=flat, tensor_columns=tensors, derived=derived, full=None, filters=(), whole=None)).df


def _decided(df: DataFrame, decision: Filter, frame: ProvFrame) -> DataFrame:
    view = _again(df, decision.held, decision.tensors, decision.derived, frame, "__rest")
    return view.filter(decision.predicate).select("__rest.*")


def _inputs_again(left: DataFrame, gate: Gate, gates: Mapping[str, Gate]) -> DataFrame:
    """Derivations whose tensor values come from aggregates that have changed."""
    source = gate.inputs
    view = _again(left, source.held, source.tensors, source.derived, ProvFrame(left, tuple(gates.values()), dict(gate.holds)), "__rest")
    view = view.select("__rest", *[v.alias(f"__t_{a}") for a, v in source.values.items()])
    columns = [f"__t_{c[2:]}" if c.startswith("t_") and c[2:] in source.values else f"__rest.{c}" for c in left.columns]
    return view.select(*[F.col(x).alias(c) for x, c in zip(columns, left.columns)])


def refold(frame: ProvFrame, inner: Gate | None = None) -> ProvFrame:
    """Recompute the aggregate columns from their tensors, then what was computed from them.

    The rows are known to be groups of ``inner``, if given: groups without values fall away.
    """
    df = frame.df
    by_gate: dict[str, list[tuple[str, str]]] = {}
    for column, tensors in frame.tensor_columns.items():
        for g, t in tensors:
            by_gate.setdefault(g, []).append((column, t))
    for name, pairs in by_gate.items():
        gate = frame.gate(name)
        values = gate_values(gate, sorted({t for _, t in pairs}))
        # the key is a new expression: the join shuffles the values anew and a hot gate can be split
        values = values.select(F.concat("gate", F.lit("")).alias("__g"), *[F.col(t).alias(f"__{c}") for c, t in pairs])
        how = "inner" if inner is not None and inner.name == name and inner.keyed else "left"
        df = df.withColumn("__r", mono.gate_ref(name)).join(values, F.col("__r") == F.col("__g"), how)
        empty = F.lit(0) if gate.counting else F.lit(None)
        df = df.withColumns({c: F.when(F.col("__r").isNotNull(), F.coalesce(F.col(f"__{c}"), empty)).otherwise(F.col(c)) for c, _ in pairs})
        df = df.drop("__r", "__g", *[f"__{c}" for c, _ in pairs])
    for column, expression in frame.derived if frame.tensor_columns else ():
        if column in df.columns:
            df = df.withColumn(column, expression)
    return replace(frame, df=df)


def valuation(frame: ProvFrame, values: DataFrame, support: bool = False) -> DataFrame:
    """Value of every result row's polynomial under ``values(token, value)``, default 1.

    Gates are evaluated bottom-up, so nothing is expanded.  With ``support`` a δ-gate
    counts 1 if its sum is not zero, else 0; without, δ is the identity.
    """
    known = values.select("token", F.col("value").cast("double").alias("value"))
    for g in frame.gates:
        sums = _products(g.derivations.select("gate", PROV), ["gate"], known).groupBy("gate")
        sums = sums.agg(F.sum("value").alias("value"))
        if support and g.delta:
            sums = sums.withColumn("value", F.when(F.col("value") != 0, 1.0).otherwise(0.0))
        known = known.unionAll(sums.select(F.col("gate").alias("token"), "value"))
    rows = frame.df.select(mono.monomial_text(PROV).alias("how"), PROV)
    return _products(rows, ["how"], known).groupBy("how").agg(F.sum("value").alias("value"))


def _products(df: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """One value per (key, monomial): copies of the monomial times the product of its tokens."""
    merged = df.groupBy(*keys, F.sort_array(PROV).alias("m")).agg(F.count(F.lit(1)).alias("c"))
    factors = merged.select(*keys, "m", "c", F.posexplode("m").alias("pos", "token"))
    factors = factors.join(known.withColumnRenamed("token", "__t"), F.col("token") == F.col("__t"), "left")
    product = F.product(F.coalesce("value", F.lit(1.0)))
    return (
        factors.groupBy(*keys, "m", "c").agg(product.alias("p")).select(*keys, "m", (F.col("c") * F.col("p")).alias("value"))
    )


def _tensor_values(frame: ProvFrame, tensors: frozenset[tuple[str, str]]) -> tuple[DataFrame, str, Column]:
    """((__g, __t, __v): these tensors, long; the type of the values; the value of one without members)."""
    folded = []
    for name in sorted({g for g, _ in tensors}):
        gate = frame.gate(name)
        aliases = [a for g, a in sorted(tensors) if g == name]
        folded += [(gate.tensors[a], a, gate_values(gate, aliases).select("gate", F.col(a).alias("v"))) for a in aliases]
    kinds = {df.schema["v"].dataType.simpleString() for *_, df in folded}
    kind = kinds.pop() if len(kinds) == 1 else "double"
    if kind.startswith(("decimal", "bigint", "int", "smallint", "tinyint")):
        kind = "decimal(38,10)"
    elif kind == "float":
        kind = "double"
    parts = [df.select(F.concat("gate", F.lit("")).alias("__g"), F.lit(a).alias("__t"), F.col("v").cast(kind).alias("__v")) for _, a, df in folded]
    empty = F.lit(0 if all(k in ("count", "distinct") for k, *_ in folded) and kind.startswith(("decimal", "double")) else None)
    return reduce(DataFrame.unionAll, parts), kind, empty.cast(kind)


def conditions(frame: ProvFrame, df: DataFrame, conds: Conditions) -> DataFrame:
    """Add ``holds``: do all symbolic conditions of the row evaluate to true?

    Only the tensors that the conditions name are folded.  Values compare in the tensor's own
    type: whole and decimal numbers exactly, dates and texts as such.
    """
    verdict: Column = F.lit(True)
    for i, (left, right) in enumerate(conds):
        c = F.get(COND, F.lit(i))
        table, kind, none = _tensor_values(frame, left)
        df = df.join(table.toDF(f"__g{i}", f"__t{i}", f"__v{i}"), (c["gate"] == F.col(f"__g{i}")) & (c["tensor"] == F.col(f"__t{i}")), "left")
        lhs = F.coalesce(F.col(f"__v{i}"), none)
        rhs = c["rhs"].cast(kind)
        if right:
            table, other, none = _tensor_values(frame, right)
            df = df.join(table.toDF(f"__h{i}", f"__u{i}", f"__w{i}"), (c["rhs_gate"] == F.col(f"__h{i}")) & (c["rhs_tensor"] == F.col(f"__u{i}")), "left")
            if other != kind:  # one of them is a double
                lhs, rhs = lhs.cast("double"), c["rhs"].cast("double")
            rhs = F.when(c["rhs_gate"].isNull(), rhs).otherwise(F.coalesce(F.col(f"__w{i}"), none))
        one = F.lit(False)
        for op in ("=", "<>", "<", "<=", ">", ">="):
            one = F.when(c["op"] == op, mono.compare(lhs, op, rhs)).otherwise(one)
        verdict = verdict & (c.isNull() | F.coalesce(one, F.lit(False)))
    df = df.withColumn("holds", verdict)
    names = [f"__{x}{i}" for i in range(len(conds)) for x in "gtvhuw"]
    return df.drop(*names)


def resolve(frame: ProvFrame) -> ProvFrame:
    """Decide the symbolic conditions and keep the rows, and gate members, that hold.

    Inner gates are decided first.  The conditions are gone from the result.
    """
    done: list[Gate] = []
    for g in frame.gates:
        if g.conds:
            view = replace(frame, gates=tuple(done))
            kept = conditions(view, g.derivations, g.conds).filter("holds").drop("holds", COND)
            g = replace(g, derivations=kept, conds=())
        done.append(g)
    frame = replace(frame, gates=tuple(done))
    if not frame.conds:
        return frame
    df = conditions(frame, frame.df, frame.conds).filter("holds").drop("holds", COND)
    return replace(frame, df=df, conds=(), whole=None, full=None, filters=(), settled=frame.settled | {"conditions that were resolved"})


def drop_empty(frame: ProvFrame) -> ProvFrame:
    """Drop rows that refer to a gate token without derivations left."""
    df = frame.df
    for g in frame.gates:
        low, high = frame.holds.get(g.name, (0, 0))
        if g.keyed and high and not g.counting:
            alive = distinct_keys(g.derivations.select("gate"), "gate").withColumnRenamed("gate", "__alive")
            df = df.withColumn("__r", mono.gate_ref(g.name))
            kept = df.join(alive, F.col("__r") == F.col("__alive"), "left_semi")
            if low == 0:
                kept = kept.unionAll(df.filter(F.col("__r").isNull()))
            df = kept.drop("__r")
    return replace(frame, df=df, whole=None, full=None, filters=(), settled=frame.settled | ({"a filter on an aggregate"} if frame.filters else set()))


def split_terms(frame: ProvFrame, gate: str) -> DataFrame:
    """Members of a gate with the verdict on their conditions: ``(gate, monomial, holds)``."""
    g = frame.gate(gate)
    position = [x.name for x in frame.gates].index(gate)
    view = replace(frame, gates=frame.gates[:position])
    judged = conditions(view, g.derivations, g.conds) if g.conds else g.derivations.withColumn("holds", F.lit(True))
    return judged.select("gate", mono.monomial_text(PROV).alias("monomial"), "holds")


def strip_conditions(frame: ProvFrame) -> ProvFrame:
    """Forget the symbolic conditions without deciding them."""
    full = None if frame.full is None else frame.full.drop(COND)
    return replace(frame, df=frame.df.drop(COND), full=full, conds=())
