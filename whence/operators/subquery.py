"""EXISTS, IN, scalar, ANY and ALL subqueries that keep the inner provenance.

The outer row is multiplied with one gate token per correlation key; the matching
inner rows stay in the gate's table.  |outer| x |inner| is never formed: existence is
decided on distinct keys, one further comparison on the per-key minimum and maximum, several of them
on the nodes of nested interval trees or, for keys with few rows, row by row (see ``ranges``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.functions import monomials as mono
from whence.functions.aggregates import Agg
from whence.functions.monomials import PROV
from whence.operators.frame import Gate, ProvFrame, attach, distinct_keys
from whence.operators.grouping import check_mode, group, with_condition
from whence.operators.ranges import box_gates, coded, few, ranked, some_match
from whence.session import stored

Pairs = Sequence[tuple[str, str]]
#: (outer column, comparison, inner column)
Triple = tuple[str, str, str]
_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def _check_types(outer: ProvFrame, inner: ProvFrame, on: Pairs) -> None:
    # keys are compared as text, so both sides must print alike
    left, right = dict(outer.df.dtypes), dict(inner.df.dtypes)
    for a, b in on:
        if left[a] != right[b] and not {left[a], right[b]} <= _WHOLE:
            raise ValueError(f"cannot correlate {a} ({left[a]}) with {b} ({right[b]}): cast one side")


def _extended(
    outer: ProvFrame, inner: ProvFrame, gate: Gate, rows: Callable[[DataFrame], DataFrame], low: int = 1, more: tuple[Gate, ...] = ()
) -> ProvFrame:
    """``outer`` with ``rows`` of it, which carry one more token of ``gate``; ``more`` are gates below it."""
    gates, holds = outer._merge(inner)
    if any(g.name in (gate.name, *[m.name for m in more]) for g in gates):
        raise ValueError(f"gate name {gate.name!r} is taken")
    holds[gate.name] = (low, 1)
    settled = outer.settled | inner.settled
    if inner.filters:
        settled = settled | {"a subquery over rows that a filter on an aggregate chose"}
    return ProvFrame(
        rows(outer.df),
        (*gates, *more, gate),
        holds,
        outer.width + gate.width,
        outer.conds,
        outer.tensor_columns,
        outer.origin.times_gate(gate.name, inner.origin),
        derived=outer.derived,
        frozen=outer.frozen,
        full=None if outer.full is None else rows(outer.full),
        filters=outer.filters,
        settled=settled,
    )


def _times(df: DataFrame, token: Column) -> DataFrame:
    return df.withColumn(PROV, F.concat(F.col(PROV), F.array(token)))


def _sum_gate(inner: ProvFrame, name: str, derivations: DataFrame, keyed: bool) -> Gate:
    return Gate(name, derivations, {}, False, keyed, dict(inner.holds), inner.width, inner.conds, inner.origin)


def _all_match(op: str, x: Column, low: Column, high: Column) -> Column:
    return {
        "<": lambda: x < low,
        "<=": lambda: x <= low,
        ">": lambda: x > high,
        ">=": lambda: x >= high,
        "=": lambda: (x == low) & (x == high),
    }[op]()


def semi_join(
    outer: ProvFrame,
    inner: ProvFrame,
    on: Pairs,
    name: str,
    residual: Triple | Sequence[Triple] | None = None,
    either: Sequence[Sequence[Triple]] = (),
) -> ProvFrame:
    """EXISTS: each outer row once, times the sum of its matching inner rows.

    ``residual`` are comparisons (outer column, comparison, inner column) checked beside the keys,
    ``either`` groups of comparisons of which one group has to hold.
    """
    residual = _triples(residual)
    if len(residual) == 1 and not either:
        ((x, op, y),) = residual
        return any_compare(outer, x, op, inner, y, name, on)
    _check_types(outer, inner, on)
    if residual or either:
        return _box_join(outer, inner, on, name, residual, either)
    outer_keys, inner_keys = [a for a, _ in on], [b for _, b in on]
    token = mono.match_token(name, inner_keys, dict(inner.df.dtypes))
    derivations = inner.df.select(token.alias("gate"), *inner._hidden()).filter(F.col("gate").isNotNull())
    gate = _sum_gate(inner, name, derivations, True)
    present = inner.df.select(*inner_keys).distinct().select(token.alias("__rk")).filter(F.col("__rk").isNotNull())
    types = dict(outer.df.dtypes)

    def rows(df: DataFrame) -> DataFrame:
        return _times(attach_semi(df, mono.match_token(name, outer_keys, types), present, "left_semi"), mono.gate_token(name, outer_keys, types))

    return _extended(outer, inner, gate, rows)


def _triples(residual: Triple | Sequence[Triple] | None) -> list[Triple]:
    if residual is None:
        return []
    return [residual] if residual and isinstance(residual[0], str) else list(residual)


_NOT = {"=": "<>", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


def _pieces(residual: Sequence[Triple], either: Sequence[Sequence[Triple]]) -> list[list[tuple[Triple, bool]]]:
    """Disjoint conjunctions that together are ``residual and (group or group ...)``.

    A group counts where the groups before it are not true: of each of them, the comparisons before one are true, and that one is
    false or unknown.  The flag marks such a comparison, which also holds where a side is NULL.
    """
    groups: list[list[Triple]] = [[]]
    if either:  # ``<>`` as ``<`` or ``>``, whose negations are ranges too
        groups = []
        for g in either:
            variants: list[list[Triple]] = [[]]
            for x, op, y in g:
                variants = [[*v, (x, o, y)] for v in variants for o in (("<", ">") if op == "<>" else (op,))]
            groups += variants
    out = []
    for i, own in enumerate(groups):
        parts = [[(t, False) for t in dict.fromkeys((*residual, *own))]]
        for earlier in groups[:i]:
            parts = [
                [*p, *[(t, False) for t in earlier[:j] if (t, False) not in p], ((x, _NOT[op], y), True)]
                for p in parts
                for j, (x, op, y) in enumerate(earlier)
                if ((x, op, y), False) not in p  # true there, so not false
            ]
        out += parts
    # where ``x < y`` is true, ``x <= y`` needs no look
    implied = lambda t, p: t[1] in ("<=", ">=") and ((t[0], t[1][0], t[2]), False) in p
    return [[(t, loose) for t, loose in p if not implied(t, p)] for p in out]


def _box_parts(outer: ProvFrame, inner: ProvFrame, on: Pairs, name: str, residual: Sequence[Triple], either: Sequence[Sequence[Triple]], carry: Sequence[str] = ()) -> tuple[Column, DataFrame, tuple[Gate, ...], DataFrame]:
    """(gate token of an outer row, the gate's derivations, the gates of tree nodes, tokens with derivations) of several comparisons.

    The nodes' derivations keep the inner columns ``carry`` too.
    """
    tests = [*residual, *[t for g in either for t in g]]
    for _, op, _ in tests:
        mono.flip(op)
    _check_types(outer, inner, [*on, *[(x, y) for x, _, y in tests]])
    outer_keys, inner_keys = [a for a, _ in on], [b for _, b in on]
    xs = list(dict.fromkeys(x for x, _, _ in tests))
    token = mono.gate_token(name, [*outer_keys, *xs], dict(outer.df.dtypes))
    asking = (outer.df if outer.full is None else outer.full).filter(_all_present(outer_keys) if on else F.lit(True))
    asking = asking.select(token.alias("gate"), *dict.fromkeys([*outer_keys, *xs])).distinct()
    given = inner.df.filter(_all_present(inner_keys) if on else F.lit(True))
    given = given.select(*inner._hidden(), *carry, *dict.fromkeys([*inner_keys, *[y for _, _, y in tests]]))
    asking, given, places = ranked(asking, given, on, list(dict.fromkeys((x, y) for x, _, y in tests)))
    # both are read for every piece and level: cut off from their lineage, so plans stay small
    asking, given = stored(asking, "asking"), stored(given, "given")
    parts, nodes, hits = [], [], []
    for i, piece in enumerate(_pieces(residual, either)):
        same = [*on, *[(x, y) for (x, op, y), loose in piece if op == "=" and not loose]]
        rest = [(t, loose) for t, loose in piece if t[1] != "=" or loose]
        strict = [t for t, loose in piece if not loose]
        params = asking.filter(_all_present([x for x, _, _ in strict]) if strict else F.lit(True))
        inside = given.filter(_all_present([y for _, _, y in strict]) if strict else F.lit(True))
        codes_of = [(*places[x, y].sides(op, loose), *places[x, y].bits()) for (x, op, y), loose in rest]
        params = params.select("gate", *[F.col(a).alias(f"__k{n}") for n, (a, _) in enumerate(same)], *[c[k].alias(f"__x{d}{n}") for n, c in enumerate(codes_of) for k, d in ((0, ""), (2, "d"))])
        inside = inside.select(*inner._hidden(), *carry, *[F.col(b).alias(f"__j{n}") for n, (_, b) in enumerate(same)], *[c[k].alias(f"__y{d}{n}") for n, c in enumerate(codes_of) for k, d in ((1, ""), (3, "d"))])
        part, gate, found = box_gates(params, inner, inside, f"{name}N{i}", [op for (_, op, _), _ in rest], len(same), carry)
        parts.append(part)
        nodes.append(gate)
        hits.append(found)
    return token, reduce(DataFrame.unionAll, parts), tuple(nodes), distinct_keys(reduce(DataFrame.unionAll, hits).select(F.col("gate").alias("__rk")), "__rk")


def _few_or_box(
    outer: ProvFrame, inner: ProvFrame, on: Pairs, name: str, residual: Sequence[Triple], either: Sequence[Sequence[Triple]]
) -> tuple[Column, DataFrame, tuple[Gate, ...], DataFrame, bool]:
    """As ``_box_parts``, but keys with few rows have their matches among the gate's derivations, and no tree; the flag says if any may."""
    tests = [*residual, *[t for g in either for t in g]]
    for _, op, _ in tests:
        mono.flip(op)
    _check_types(outer, inner, [*on, *[(x, y) for x, _, y in tests]])
    token = mono.gate_token(name, list(dict.fromkeys([*[a for a, _ in on], *[x for x, _, _ in tests]])), dict(outer.df.dtypes))
    if inner.conds:  # conditions stay with the nodes
        return (*_box_parts(outer, inner, on, name, residual, either), False)
    near, far = few(outer, inner, on, token, residual, either)
    if far is None:
        return token, near, (), distinct_keys(near.select(F.col("gate").alias("__rk")), "__rk"), True
    _, parts, nodes, hits = _box_parts(*far, on, name, residual, either)
    if near is None:
        return token, parts, nodes, hits, False
    return token, parts.unionAll(near), nodes, hits.unionAll(distinct_keys(near.select(F.col("gate").alias("__rk")), "__rk")), True


def _box_join(outer: ProvFrame, inner: ProvFrame, on: Pairs, name: str, residual: Sequence[Triple], either: Sequence[Sequence[Triple]]) -> ProvFrame:
    token, parts, nodes, hits, direct = _few_or_box(outer, inner, on, name, residual, either)
    names = frozenset(n.name for n in nodes)
    made_of = replace(inner.origin.grouped(name), stored=names | inner.origin.stored if direct else names, unique=inner.origin.unique or not direct)
    holds = {n: (1 if len(names) == 1 and not direct else 0, 1) for n in names}
    if direct:
        holds |= {g: (0 if nodes else lo, hi) for g, (lo, hi) in inner.holds.items()}
    # tokens of a derivation: of one node, or those of an inner row
    width = inner.width * (1 + len(nodes)) if direct else inner.width
    gate = Gate(name, parts, {}, False, True, holds, width, (), made_of)
    # a NULL key or compared column asks for nothing, so its token is in no part
    return _extended(outer, inner, gate, lambda df: _times(attach_semi(df, token, hits, "left_semi"), token), more=nodes)


def attach_semi(df: DataFrame, key: Column, present: DataFrame, how: str) -> DataFrame:
    return df.withColumn("__k", key).join(present, F.col("__k") == F.col("__rk"), how).drop("__k")


def anti_join(
    outer: ProvFrame,
    inner: ProvFrame,
    on: Pairs,
    residual: Triple | Sequence[Triple] | None = None,
    either: Sequence[Sequence[Triple]] = (),
) -> ProvFrame:
    """NOT EXISTS: the outer row keeps its annotation; no difference of annotations is computed.

    ``residual`` and ``either`` as in ``semi_join``.
    """
    residual = _triples(residual)
    _check_types(outer, inner, on)
    outer_keys, inner_keys = [a for a, _ in on], [b for _, b in on]
    types = dict(outer.df.dtypes)
    token = mono.match_token("", inner_keys, dict(inner.df.dtypes))
    if len(residual) > 1 or either:
        key, _, _, hits, _ = _few_or_box(outer, inner, on, "", residual, either)
        return outer._each(lambda df: attach_semi(df, key, hits, "left_anti"))
    if not residual:
        present = inner.df.select(*inner_keys).distinct().select(token.alias("__rk"))
        return outer._each(lambda df: attach_semi(df, mono.match_token("", outer_keys, types), present, "left_anti"))
    ((x, op, y),) = residual
    if op == "=":
        return anti_join(outer, inner, [*on, (x, y)])
    bounds = _bounds(inner, inner_keys, y).select(token.alias("__rk"), "__low", "__high")

    def rows(df: DataFrame) -> DataFrame:
        df = attach(df, mono.match_token("", outer_keys, types), bounds, "left")
        some = F.coalesce(some_match(op, F.col(x), F.col("__low"), F.col("__high")), F.lit(False))
        return df.filter(~some).drop("__low", "__high")

    return outer._each(rows)


def _bounds(inner: ProvFrame | DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    rows = inner.df if isinstance(inner, ProvFrame) else inner
    return rows.groupBy(*keys).agg(
        F.min(y).alias("__low"),
        F.max(y).alias("__high"),
        F.count(F.lit(1)).alias("__n"),
        F.count(y).alias("__known"),
    )


def in_(outer: ProvFrame, inner: ProvFrame, pairs: Pairs, name: str, on: Pairs = ()) -> ProvFrame:
    """``(a, b) IN (SELECT x, y ...)``, correlated by ``on``; inner duplicates do not repeat the row."""
    return semi_join(outer, inner, [*pairs, *on], name)


def not_in(outer: ProvFrame, inner: ProvFrame, x: str | Sequence[str], y: str | Sequence[str], on: Pairs = ()) -> ProvFrame:
    """``x NOT IN (SELECT y ...)``, of one column or of lists of columns, with SQL's NULL rules.

    True over an empty list.  Otherwise false if some row of the list is equal, and unknown, so never true, if some
    row is equal wherever neither it nor x is NULL.
    """
    xs, ys = ([x], [y]) if isinstance(x, str) else (list(x), list(y))
    if len(xs) != len(ys):
        raise ValueError(f"{len(xs)} columns against {len(ys)}")
    _check_types(outer, inner, [*zip(xs, ys), *on])
    if len(xs) > 1:
        return _not_in_rows(outer, inner, xs, ys, on)
    x, y = xs[0], ys[0]
    outer_keys, inner_keys = [a for a, _ in on], [b for _, b in on]
    types = dict(outer.df.dtypes)
    if on:
        counts = _bounds(inner, inner_keys, y).select(
            mono.match_token("", inner_keys, dict(inner.df.dtypes)).alias("__rk"), "__n", "__known"
        )
    else:
        total, known = inner.df.agg(F.count(F.lit(1))).scalar(), inner.df.agg(F.count(y)).scalar()

    def rows(df: DataFrame) -> DataFrame:
        if on:
            df = attach(df, mono.match_token("", outer_keys, types), counts, "left")
            df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("__n", "__known")})
        else:
            df = df.withColumns({"__n": total, "__known": known})
        some = F.col(x).isNotNull() & (F.col("__n") == F.col("__known"))
        return df.filter((F.col("__n") == 0) | some).drop("__n", "__known")

    return anti_join(outer._each(rows), inner, [(x, y), *on])


def _not_in_rows(outer: ProvFrame, inner: ProvFrame, xs: list[str], ys: list[str], on: Pairs) -> ProvFrame:
    """An anti-join for each pattern of NULLs in the list.

    A row of the list is filed, for each pattern of NULLs that an outer row may have, under the values of the columns that are
    NULL on neither side; an outer row asks for each pattern of the list once: 2^k look-ups of k columns, no pairs.
    """
    k, outer_keys, inner_keys = len(xs), [a for a, _ in on], [b for _, b in on]
    types, inner_types = dict(outer.df.dtypes), dict(inner.df.dtypes)

    def mask(names: list[str]) -> Column:
        return reduce(Column.__add__, [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(names)])

    def filed(own: Column, other: Column, names: list[str], keys: list[str], kinds, of: Column) -> Column:
        """Text of the list's pattern, the columns left out, the values of the others and the keys."""
        both = own.bitwiseOR(other)
        values = [F.when(both.bitwiseAND(F.lit(1 << i)) == 0, mono.key_text([c], kinds)).otherwise(F.lit("")) for i, c in enumerate(names)]
        values = [mono.key_part(v, "|") for v in values]
        return F.when(_all_present(keys) if keys else F.lit(True), F.concat_ws("|", of.cast("string"), both.cast("string"), *values, mono.key_text(keys, kinds)))

    listed = inner.df.select(*dict.fromkeys([*inner_keys, *ys])).distinct().withColumn("__m", mask(ys))
    listed = listed.withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1))))
    present = listed.select(filed(F.col("__m"), F.col("__o"), ys, inner_keys, inner_types, F.col("__m")).alias("__rk"))
    present = distinct_keys(present.filter(F.col("__rk").isNotNull()), "__rk")

    def rows(df: DataFrame) -> DataFrame:
        for pattern in range(1 << k):
            key = filed(mask(xs), F.lit(pattern), xs, outer_keys, types, F.lit(pattern))
            df = attach_semi(df, key, present, "left_anti")
        return df

    return outer._each(rows)


def scalar_compare(
    outer: ProvFrame,
    x: str | Sequence[str],
    op: str,
    inner: ProvFrame,
    agg: Agg | Sequence[Agg],
    name: str,
    on: Pairs = (),
    *,
    mode: str = "resolved",
    or_where: Column | None = None,
    residual: Triple | Sequence[Triple] | None = None,
) -> ProvFrame:
    """``x op (SELECT agg ... )``, correlated by ``on`` or not.

    Lists of columns and aggregates compare as rows, first column first.  ``residual`` are further comparisons
    (outer column, comparison, inner column) in the subquery.  ``or_where`` is a second disjunct: such rows stay too, and take the subquery's
    annotation only if the comparison itself holds.  COUNT over no rows is 0.
    """
    check_mode(mode)
    mono.flip(op)
    xs, aggs = ([x], [agg]) if isinstance(x, str) else (list(x), list(agg))
    if len(xs) != len(aggs):
        raise ValueError(f"{len(xs)} columns against {len(aggs)} aggregates")
    if mode == "symbolic" and (or_where is not None or len(xs) > 1 or residual):
        raise ValueError("a disjunction, a row value or a further comparison has no symbolic form here")
    _check_types(outer, inner, on)
    if residual := _triples(residual):
        if or_where is not None or len(xs) > 1:
            raise ValueError("a further comparison takes one column and no disjunction")
        return _scalar_range(outer, xs[0], op, inner, aggs[0], name, on, residual)
    outer_keys, inner_keys = [a for a, _ in on], [b for _, b in on]
    types = dict(outer.df.dtypes)
    if on:  # equal to no outer row
        inner = inner._each(lambda df: df.filter(_all_present(inner_keys)))
    names = ["v"] if len(aggs) == 1 else [f"v{i}" for i in range(len(aggs))]
    grouped = group(inner, inner_keys, name, dict(zip(names, aggs)), mode="symbolic" if inner.conds else "resolved")
    counting = all(a.kind in ("count", "distinct") for a in aggs)
    gate = replace(grouped.gate(name), counting=counting)
    token = mono.gate_token(name, outer_keys, types)
    match = mono.match_token(name, outer_keys, types)
    none = F.array().cast("array<string>")
    per_key = inner.df.groupBy(*inner_keys).agg(*[a.value().alias(f"__{n}") for n, a in zip(names, aggs)]) if on else None
    if on:
        found = mono.match_token(name, inner_keys, dict(inner.df.dtypes)).alias("__rk")
        per_key = per_key.select(found, *[f"__{n}" for n in names]).filter(F.col("__rk").isNotNull())

    if mode == "symbolic":
        if not on or counting:  # of a COUNT also the outer rows without a match, whose count is 0
            return _symbolic(outer, inner, gate, lambda df: df, token, x, op)
        return _symbolic(outer, inner, gate, lambda df: attach_semi(df, match, per_key.select("__rk"), "left_semi"), token, x, op)

    left = F.col(xs[0]) if len(xs) == 1 else _as_value(xs)
    right = F.col("__v") if len(names) == 1 else F.struct(*[F.col(f"__{n}").alias(f"c{i}") for i, n in enumerate(names)])
    whole = mono.compare(left, op, right)
    if len(names) > 1:
        whole = F.when(_all_present([*xs, *[f"__{n}" for n in names]]), whole)
    holds = F.coalesce(whole, F.lit(False))
    optional = counting or or_where is not None

    def candidates(df: DataFrame) -> DataFrame:
        """The rows that may satisfy the comparison, beside the subquery's values."""
        if on:
            df = df.withColumn("__k", match).join(per_key, F.col("__k") == F.col("__rk"), "left" if optional else "inner")
            if counting:
                df = df.withColumns({f"__{n}": F.coalesce(F.col(f"__{n}"), F.lit(0)) for n in names})
        else:
            df = df.withColumns({f"__{n}": inner.df.agg(a.value()).scalar() for n, a in zip(names, aggs)})
        if or_where is not None:
            taken = holds & F.col("__rk").isNotNull() if on else holds
            df = df.withColumn(PROV, F.concat(F.col(PROV), F.when(taken, F.array(token)).otherwise(none)))
        elif on and counting:
            df = df.withColumn(PROV, F.concat(F.col(PROV), F.when(F.col("__rk").isNotNull(), F.array(token)).otherwise(none)))
        else:
            df = _times(df, token)
        return df.drop("__k", "__rk")

    frame = _extended(outer, inner, gate, candidates, low=0 if or_where is not None or (counting and on) else 1)
    if or_where is not None:
        frame = frame._each(lambda df: df.filter(holds | or_where)).settle("a scalar comparison below OR")
    else:
        # decided again after deletions, like every filter on an aggregate
        values = {f"__{n}": ((name, n),) for n in names if n in gate.tensors}
        frame = replace(frame, tensor_columns={**frame.tensor_columns, **values}).filter(holds)
    drop = [f"__{n}" for n in names]
    return frame._each(lambda df: df.drop(*drop), same_rows=True)


def _scalar_range(outer: ProvFrame, x: str, op: str, inner: ProvFrame, agg: Agg, name: str, on: Pairs, residual: list[Triple]) -> ProvFrame:
    """A scalar subquery over a range of inner rows: every tree node is folded once, an outer row adds its nodes up."""
    if agg.kind not in ("sum", "count", "avg", "min", "max"):
        raise ValueError(f"{agg.kind} can't be added up from ranges")
    if inner.conds:
        raise ValueError("resolve the symbolic conditions of the subquery first")
    value = F.lit(1) if agg.column is None else mono.as_column(agg.column)
    valued = inner._each(lambda df: df.withColumn("__a", value))
    token, parts, (node,), _ = _box_parts(outer, valued, on, name, residual, (), ["__a"])
    folded = node.derivations.groupBy("gate").agg(
        F.sum("__a").alias("__s") if agg.kind in ("sum", "avg") else F.lit(None).alias("__s"),
        F.count("__a").alias("__n"), F.min("__a").alias("__lo"), F.max("__a").alias("__hi"),
    )
    folded = parts.withColumn("__node", F.get(PROV, F.lit(0))).join(folded.select(F.concat("gate", F.lit("")).alias("__g"), "__s", "__n", "__lo", "__hi"), F.col("__node") == F.col("__g"))
    counting = agg.kind == "count"
    total = {
        "sum": lambda: F.sum("__s"), "count": lambda: F.coalesce(F.sum("__n"), F.lit(0)), "avg": lambda: F.sum("__s").cast("double") / F.sum("__n"),
        "min": lambda: F.min("__lo"), "max": lambda: F.max("__hi"),
    }[agg.kind]()
    per_row = folded.groupBy("gate").agg(agg._scaled(total).alias("__v")).select(F.concat("gate", F.lit("")).alias("__rk"), "__v")
    made_of = replace(inner.origin.grouped(node.name), stored=frozenset([node.name]))
    gate = Gate(name, parts, {}, True, True, {node.name: (1, 1)}, inner.width, (), made_of, counting)
    none = F.array().cast("array<string>")

    def rows(df: DataFrame) -> DataFrame:
        df = df.withColumn("__k", token).join(per_row, F.col("__k") == F.col("__rk"), "left" if counting else "inner")
        found = F.coalesce(F.col("__v"), F.lit(0)) if counting else F.col("__v")
        df = df.filter(F.coalesce(mono.compare(F.col(x), op, found), F.lit(False)))
        factor = F.when(F.col("__rk").isNotNull(), F.array(token)).otherwise(none)
        return df.withColumn(PROV, F.concat(F.col(PROV), factor)).drop("__k", "__rk", "__v")

    return _extended(outer, inner, gate, rows, low=0 if counting else 1, more=(node,)).settle("a scalar subquery over a range")


def _symbolic(
    outer: ProvFrame, inner: ProvFrame, gate: Gate, rows: Callable[[DataFrame], DataFrame], token: Column, x: str, op: str
) -> ProvFrame:
    """All candidates stay, with the condition ``[tensor flip(op) 1⊗x]`` or tensor against tensor."""
    frame = _extended(outer, inner, gate, lambda df: _times(rows(df), token))
    if x in outer.tensor_columns:
        tensors = outer.tensor_columns[x]
        if len(tensors) > 1:
            raise ValueError(f"{x!r} stands for tensors of several gates: compare before the union")
        ((g, t),) = tensors
        return with_condition(frame, mono.tensor_condition(mono.gate_ref(g), t, op, token, "v"), tensors, ((gate.name, "v"),))
    return with_condition(frame, mono.condition(token, "v", mono.flip(op), F.col(x)), ((gate.name, "v"),))


def having_subquery(
    frame: ProvFrame, alias: str, op: str, inner: ProvFrame, agg: Agg, name: str, mode: str = "resolved"
) -> ProvFrame:
    """``HAVING alias op (SELECT agg ...)`` on an already grouped frame."""
    return scalar_compare(frame, alias, op, inner, agg, name, mode=mode)


def _as_value(columns: str | Sequence[str]) -> Column:
    return F.col(columns) if isinstance(columns, str) else F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])


def any_compare(
    outer: ProvFrame,
    x: str | Sequence[str],
    op: str,
    inner: ProvFrame,
    y: str | Sequence[str],
    name: str,
    on: Pairs = (),
) -> ProvFrame:
    """``x op ANY (SELECT y ...)``; lists of columns compare as rows, first column first.

    The gate token holds the key and x.  Its derivations, the inner rows with ``x op y``,
    are sums over intervals of whole numbers: of the values themselves or, for doubles, texts, wide decimals and
    rows, of their places in the order of all values (see ``ranges``).
    """
    mono.flip(op)
    if op == "=":
        xs, ys = ([x], [y]) if isinstance(x, str) else (list(x), list(y))
        return semi_join(outer, inner, [*zip(xs, ys), *on], name)
    _check_types(outer, inner, on)
    xs = [x] if isinstance(x, str) else list(x)
    outer_keys, inner_keys = [a for a, _ in on], [b for _, b in on]
    types = dict(outer.df.dtypes)
    known = inner.df.filter(_all_present([y] if isinstance(y, str) else y)).withColumn("__y", _as_value(y))
    value = F.when(_all_present(xs), _as_value(x))
    if on:
        bounds = known.groupBy(*inner_keys).agg(F.min("__y").alias("__low"), F.max("__y").alias("__high"))
        bounds = bounds.select(mono.match_token("", inner_keys, dict(inner.df.dtypes)).alias("__rk"), "__low", "__high")
    else:
        low, high = known.agg(F.min("__y")).scalar(), known.agg(F.max("__y")).scalar()

    def matching(df: DataFrame) -> DataFrame:
        df = df.withColumn("__x", value)
        if not on:
            return df.filter(some_match(op, F.col("__x"), low, high))
        df = attach(df, mono.match_token("", outer_keys, types), bounds, "inner")
        return df.filter(some_match(op, F.col("__x"), F.col("__low"), F.col("__high"))).drop("__low", "__high")

    token = mono.gate_token(name, [*outer_keys, *xs], types)
    params = matching(outer.df if outer.full is None else outer.full)
    params = params.select(token.alias("gate"), "__x", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(outer_keys)])
    params, inside, places = coded(params.distinct(), known, [("__x", "__y")])
    mine, theirs = places["__x", "__y"].sides(op, False)
    params = params.withColumn("__x0", mine)
    inside = inside.select(theirs.alias("__y0"), *inner._hidden(), *[F.col(k).alias(f"__j{i}") for i, k in enumerate(inner_keys)])
    parts, nodes, _ = box_gates(params, inner, inside, f"{name}N", [op], len(on))
    # intervals of one outer value are disjoint, so each inner row comes once
    gate = Gate(name, parts, {}, False, True, {nodes.name: (1, 1)}, inner.width, (), inner.origin.grouped(nodes.name))
    return _extended(outer, inner, gate, lambda df: _times(matching(df).drop("__x"), token), more=(nodes,))


def _all_present(columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def all_compare(
    outer: ProvFrame, x: str | Sequence[str], op: str, inner: ProvFrame, y: str | Sequence[str], name: str, on: Pairs = ()
) -> ProvFrame:
    """``x op ALL (SELECT y ...)``: true over no rows, unknown as soon as a y is NULL; lists of columns compare as rows.

    The row is multiplied with the sum of all inner rows it was compared with.
    ``<> ALL`` is NOT IN and keeps the outer annotation alone.
    """
    mono.flip(op)
    if op == "<>":
        return not_in(outer, inner, x, y, on)
    _check_types(outer, inner, on)
    outer_keys, inner_keys = [a for a, _ in on], [b for _, b in on]
    types = dict(outer.df.dtypes)
    xs, ys = ([x], [y]) if isinstance(x, str) else (list(x), list(y))
    if len(xs) != len(ys):
        raise ValueError(f"{len(xs)} columns against {len(ys)}")
    valued = inner.df.withColumn("__y", F.when(_all_present(ys), _as_value(y)))
    columns = ("__low", "__high", "__n", "__known")
    bounds = _bounds(valued, inner_keys, "__y")
    if on:
        bounds = bounds.select(mono.match_token(name, inner_keys, dict(inner.df.dtypes)).alias("__rk"), *columns)
    none = F.array().cast("array<string>")

    def rows(df: DataFrame) -> DataFrame:
        if on:
            df = attach(df, mono.match_token(name, outer_keys, types), bounds, "left")
        else:
            df = df.withColumns({c: bounds.select(c).scalar() for c in columns})
        total = F.coalesce(F.col("__n"), F.lit(0))
        value = F.when(_all_present(xs), _as_value(x))
        verdict = _all_match(op, value, F.col("__low"), F.col("__high")) & (F.col("__known") == total)
        df = df.filter((total == 0) | F.coalesce(verdict, F.lit(False)))
        factor = F.when(total > 0, F.array(mono.gate_token(name, outer_keys, types))).otherwise(none)
        return df.withColumn(PROV, F.concat(F.col(PROV), factor)).drop(*columns)

    token = mono.match_token(name, inner_keys, dict(inner.df.dtypes))
    derivations = inner.df.select(token.alias("gate"), *inner._hidden()).filter(F.col("gate").isNotNull())
    return _extended(outer, inner, _sum_gate(inner, name, derivations, bool(on)), rows, low=0).settle("a comparison with ALL")
