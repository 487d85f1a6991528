"""Set-based checks that a result and its provenance agree."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.functions import monomials as mono
from whence.functions.monomials import PROV
from whence.operators.evaluate import gate_values
from whence.operators.frame import ProvFrame
from whence.operators.semirings import Polynomials, expand

_NUMERIC = ("double", "float", "decimal")


def _rounded(df: DataFrame, columns: list[str], digits: int) -> DataFrame:
    types = dict(df.dtypes)
    exact = f"decimal(38,{digits})"
    return df.select(
        *[F.col(c).cast(exact).alias(c) if types[c].startswith(_NUMERIC) else F.col(c) for c in columns]
    )


def differences(plain: DataFrame, annotated: ProvFrame | DataFrame, ignore=("cntprov",), digits: int = 6) -> DataFrame:
    """Rows whose number of copies differs between the plain and the annotated result.

    Empty if both are the same bag.  Copies are counted before the shuffle, so a row
    that makes up a third of the result is one record of it.
    """
    other = annotated.plain() if isinstance(annotated, ProvFrame) else annotated
    columns = [c for c in plain.columns if c not in (PROV, *ignore)]
    left = _rounded(plain, columns, digits).withColumn("__n", F.lit(1))
    right = _rounded(other, columns, digits).withColumn("__n", F.lit(-1))
    return (
        left.unionAll(right).groupBy(*columns).agg(F.sum("__n").alias("surplus")).filter(F.col("surplus") != 0)
    )


@dataclass(frozen=True)
class Witness:
    """A base table's part in a monomial: its frame, token prefix, and which occurrence."""

    base: ProvFrame
    prefix: str
    occurrence: int = 0

    @property
    def family(self) -> str:
        """What all tokens of the table begin with, its qualified name included."""
        known = self.base.origin.base
        return next(iter(known)) if len(known) == 1 else self.prefix


def _of_family(token: Column, family: str, families: set[str]) -> Column:
    """Does the token belong to the family, and not to one with a longer name that begins alike?"""
    longer = [f for f in sorted(families) if f != family and f.startswith(family)]
    return reduce(Column.__and__, [~token.startswith(f) for f in longer], token.startswith(family))


def resolve_tokens(tokens: DataFrame, bases: Mapping[str, Witness]) -> DataFrame:
    """``(token, table, row)``: every token with its base row as JSON."""
    parts = []
    for table, w in bases.items():
        mine = tokens.select("token").filter(F.col("token").startswith(w.family)).distinct()
        base = w.base.df.select(F.get(PROV, F.lit(0)).alias("__t"), F.to_json(F.struct(*w.base.columns)).alias("row"))
        parts.append(mine.join(base, F.col("token") == F.col("__t")).select("token", F.lit(table).alias("table"), "row"))
    return reduce(DataFrame.unionAll, parts)


def _looked_up(df: DataFrame, tables: Mapping[str, Witness], families: set[str]) -> tuple[DataFrame, Column]:
    """The rows widened by the base rows of their tokens, as ``<alias>__<column>``; whether all are found."""
    found: Column = F.lit(True)
    for alias, w in tables.items():
        # a sorted monomial lists the occurrences of one table in a fixed order
        family = w.family
        mine = F.filter(PROV, lambda t: _of_family(t, family, families))
        df = df.withColumn(f"__t_{alias}", F.get(mine, F.lit(w.occurrence)))
        base = w.base.df.select(
            F.get(PROV, F.lit(0)).alias(f"__b_{alias}"), *[F.col(c).alias(f"{alias}__{c}") for c in w.base.columns]
        )
        df = df.join(base, F.col(f"__t_{alias}") == F.col(f"__b_{alias}"), "left")
        found = found & F.col(f"__b_{alias}").isNotNull()
    return df, found


def replay(frame: ProvFrame, tables: Mapping[str, Witness], where: Column, columns: Mapping[str, Column]) -> DataFrame:
    """Look every row's tokens up in the base tables and recompute the row.

    One equi-join per table occurrence.  Returns the row's columns, ``recomputed_*``
    and ``ok``: all tokens found, ``where`` true and all columns equal.  Of a grouped result
    every monomial of every row is looked up, ``columns`` being what its members share.
    """
    df = frame.df
    if frame.gates:
        rows = df.select(*frame.columns, F.concat(mono.monomial_text(PROV), F.lit("")).alias("__row"))
        terms = expand(frame).terms.select("out", F.col("m").alias(PROV))
        df = terms.join(rows, F.col("out") == F.col("__row")).drop("out", "__row")
    df, found = _looked_up(df, tables, {w.family for w in tables.values()} | frame.origin.base)
    df = df.withColumns({f"recomputed_{c}": e for c, e in columns.items()})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"recomputed_{c}")) for c in columns], found)
    ok = F.coalesce(same & where, F.lit(False))
    return df.select(*columns, *[f"recomputed_{c}" for c in columns], ok.alias("ok"))


@dataclass(frozen=True)
class Step:
    """How one derivation of a gate, or one result row, is made again.

    ``where`` has to hold, ``columns`` give the gate's key in its order (of a result row: columns of it).  Both read
    base rows as ``<alias>__<column>`` and the groups of inner gates as ``<alias>__<key column>``.  ``gates`` names
    the gate of each alias; several aliases of one gate take its tokens in order.
    """

    columns: Mapping[str, Column]
    tables: Mapping[str, Witness] = field(default_factory=dict)
    gates: Mapping[str, str] = field(default_factory=dict)
    where: Column | None = None


def replay_circuit(frame: ProvFrame, rows: Step, steps: Mapping[str, Step]) -> DataFrame:
    """``(token, members, failed)`` of every gate token and every result row, without expanding a product.

    From the innermost gate outwards each derivation is joined once to its base rows and to the groups of
    the gates it holds.  It fails if a token is missing or left over, if ``where`` does not hold, if the key made
    from it is not that of its gate, or if a group it stands on has failed or has no derivation at all.  The cost is that
    of the circuit, also where the expanded polynomials are products of it; a failure reaches every row above it.
    """
    if missing := {g.name for g in frame.gates} - set(steps):
        raise ValueError(f"no step says how these gates are made: {sorted(missing)}")
    every = [rows, *steps.values()]
    families = {w.family for s in every for w in s.tables.values()} | frame.origin.base
    groups: dict[str, DataFrame] = {}
    verdicts = []
    for g in frame.gates:
        made = _made(g.derivations.select("gate", PROV), steps[g.name], families, groups)
        names = list(steps[g.name].columns)
        same = F.col("gate") == mono.gate_token(g.name, names, dict(made.dtypes))
        made = made.withColumn("__ok", F.coalesce(F.col("__ok") & same, F.lit(False)))
        key = F.struct(*names) if names else F.struct(F.lit(1).alias("__one"))
        failed = F.sum(F.when(F.col("__ok"), 0).otherwise(1)).cast("long")
        judged = made.groupBy("gate").agg(
            F.count(F.lit(1)).alias("members"), failed.alias("failed"), F.min(F.when(F.col("__ok"), key)).alias("key")
        )
        groups[g.name] = judged
        verdicts.append(judged.select(F.col("gate").alias("token"), "members", "failed"))
    own = {c: f"__own_{c}" for c in rows.columns}
    df = frame.df.select(PROV, *[F.col(c).alias(own[c]) for c in rows.columns])
    made = _made(df, rows, families, groups)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(o)) for c, o in own.items()], F.col("__ok"))
    wrong = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    made = made.select(mono.monomial_text(PROV).alias("token"), wrong.alias("__wrong"))
    verdicts.append(made.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.sum("__wrong").cast("long").alias("failed")))
    return reduce(DataFrame.unionAll, verdicts)


def _made(df: DataFrame, step: Step, families: set[str], groups: Mapping[str, DataFrame]) -> DataFrame:
    """The rows with the columns the step makes from base rows and inner groups, and ``__ok``."""
    before = df.columns
    df, found = _looked_up(df.withColumn(PROV, F.sort_array(PROV)), step.tables, families)
    taken: dict[str, int] = {}
    for alias, name in step.gates.items():
        nth = taken.get(name, 0)
        taken[name] = nth + 1
        begin = f"{name}["
        mine = F.filter(PROV, lambda t: t.startswith(begin))  # noqa: B023
        # a key of its own: a group that very many derivations hold can be split
        inner = groups[name].select(F.concat("gate", F.lit("")).alias(f"__g_{alias}"), (F.col("failed") == 0).alias(f"__f_{alias}"), *[
            F.col(f"key.{c}").alias(f"{alias}__{c}") for c in groups[name].schema["key"].dataType.names
        ])
        df = df.withColumn(f"__t_{alias}", F.get(mine, F.lit(nth)))
        df = df.join(inner, F.col(f"__t_{alias}") == F.col(f"__g_{alias}"), "left")
        found = found & F.coalesce(F.col(f"__f_{alias}"), F.lit(False))
    found = found & (F.size(PROV) == len(step.tables) + len(step.gates))
    where = F.lit(True) if step.where is None else step.where
    return df.select(*before, *[e.alias(c) for c, e in step.columns.items()], F.coalesce(found & where, F.lit(False)).alias("__ok"))


def derivation_count(frame: ProvFrame, poly: Polynomials, column: str = "cntprov") -> DataFrame:
    """``(out, terms, cntprov, ok)``: the polynomial with every token 1 against the counted derivations."""
    terms = poly.terms.groupBy("out").agg(F.sum("c").alias("terms"))
    rows = frame.df.select(F.array_join(F.sort_array(PROV), " . ").alias("__o"), column)
    joined = rows.join(terms, F.col("__o") == F.col("out"), "left")
    return joined.select(
        F.col("__o").alias("out"), "terms", column, F.col("terms").eqNullSafe(F.col(column)).alias("ok")
    )


def aggregate_check(frame: ProvFrame, alias: str, tolerance: float = 1e-6) -> DataFrame:
    """``(gate, plain, folded, ok)``: the aggregate column against its tensor folded again."""
    ((name, tensor),) = frame.tensor_columns[alias]
    g = frame.gate(name)
    rows = frame.df.select(F.get(PROV, F.lit(0)).alias("__g"), F.col(alias).cast("double").alias("plain"))
    values = gate_values(g).select("gate", F.col(tensor).cast("double").alias("folded"))
    joined = rows.join(values, F.col("__g") == F.col("gate"), "left")
    near = F.abs(F.col("plain") - F.col("folded")) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs("plain"))
    ok = F.coalesce(near, F.col("plain").isNull() & F.col("folded").isNull())
    return joined.select(F.col("__g").alias("gate"), "plain", "folded", ok.alias("ok"))
