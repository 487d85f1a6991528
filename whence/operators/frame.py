"""ProvFrame: a DataFrame whose rows carry their provenance.

Every row has exactly one monomial in ``prov``.  Wherever a sum of derivations
arises (grouping, distinct, EXISTS, a scalar subquery) the row gets one *gate
token* and the derivations stay in the gate's own long table, one row each.  So
no polynomial is ever collected into a cell, the product of two annotations is an
array concatenation, and a sum costs no shuffle at all until somebody reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count, zip_longest

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whence.functions import monomials as mono
from whence.functions.monomials import COND, PROV
from whence.session import checkpointed

#: Tensors a column or a condition may stand for, as (gate, alias); a row's own tokens tell which.
Tensors = tuple[tuple[str, str], ...]
#: Of every symbolic condition of a row, the tensors on its left and its right.
Conditions = tuple[tuple[frozenset[tuple[str, str]], frozenset[tuple[str, str]]], ...]

RESERVED = (PROV, COND)
#: Keys over which a join spreads the rows, where they have fewer.
SPREAD = 1024
_GATE = "gate"
#: Columns that hold a row's values at a filter, to decide it again.
HELD = "__f"
_HELD = count()
_WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Filter:
    """A decision on values that come from aggregates.

    ``held`` is a column of ``ProvFrame.full`` with the row's values at that time, of which
    ``tensors`` and ``derived`` say how to make them again.
    """

    held: str
    tensors: Mapping[str, Tensors]
    derived: tuple[tuple[str, Column], ...]
    predicate: Column | str


@dataclass(frozen=True)
class Inputs:
    """How to make a gate's tensors again whose inputs were aggregates themselves; as in ``Filter``."""

    held: str
    tensors: Mapping[str, Tensors]
    derived: tuple[tuple[str, Column], ...]
    values: Mapping[str, Column]


def held_name() -> str:
    return f"{HELD}{next(_HELD)}"


@dataclass(frozen=True)
class Origin:
    """Where tokens come from, to know when a monomial cannot occur twice.

    ``stored`` are the base tables and gates whose tokens the rows carry, ``base`` the
    base tables they come down to.  ``unique``: no two rows have the same monomial;
    ``flat``: nor do they after expansion, and no token repeats within one.  Then sums
    need no merging, so reading them off costs no shuffle.
    """

    stored: frozenset[str] = frozenset()
    base: frozenset[str] = frozenset()
    unique: bool = False
    flat: bool = False

    @staticmethod
    def table(name: str) -> Origin:
        return Origin(frozenset([name]), frozenset([name]), True, True)

    def with_(self, other: Origin) -> Origin:
        """Of a join or a union of both."""
        return Origin(
            self.stored | other.stored,
            self.base | other.base,
            self.unique and other.unique and not self.stored & other.stored,
            self.flat and other.flat and not self.base & other.base,
        )

    def grouped(self, name: str) -> Origin:
        return Origin(frozenset([name]), self.base, True, self.flat)

    def times_gate(self, name: str, inner: Origin) -> Origin:
        """Of rows that get one token of a gate over ``inner`` each."""
        flat = self.flat and inner.flat and not self.base & inner.base
        return Origin(self.stored | {name}, self.base | inner.base, self.unique, flat)


@dataclass(frozen=True)
class Gate:
    """A named family of sums.

    ``derivations`` has the columns ``gate`` (token), ``prov`` (monomial), ``cond``
    if the members carry symbolic conditions, and ``t_<alias>`` per tensor.
    ``holds`` gives, per inner gate, the least and greatest number of its tokens in
    one derivation; ``width`` is the greatest number of base tokens after expansion.
    A token of a ``counting`` gate stays a factor also when it has no derivations: the
    gate stands for a COUNT, which is then 0.
    """

    name: str
    derivations: DataFrame
    tensors: Mapping[str, str] = field(default_factory=dict)
    delta: bool = False
    keyed: bool = True
    holds: Mapping[str, tuple[int, int]] = field(default_factory=dict)
    width: int = 1
    conds: Conditions = ()
    origin: Origin = Origin()
    counting: bool = False
    inputs: Inputs | None = None


@dataclass(frozen=True)
class ProvFrame:
    df: DataFrame
    gates: tuple[Gate, ...] = ()
    holds: Mapping[str, tuple[int, int]] = field(default_factory=dict)
    width: int = 1
    conds: Conditions = ()
    tensor_columns: Mapping[str, Tensors] = field(default_factory=dict)
    origin: Origin = Origin()
    # name of the gate if the rows are exactly its groups, each with its token alone
    whole: str | None = None
    # columns computed next to tensor columns, to be computed again when tensors change, in order
    derived: tuple[tuple[str, Column], ...] = ()
    # columns that were computed from tensor columns and can't be computed again
    frozen: frozenset[str] = frozenset()
    # the rows before the filters on values from aggregates, and these filters: what a deletion decides again
    full: DataFrame | None = None
    filters: tuple[Filter, ...] = ()
    # decisions that a deletion can't take again
    settled: frozenset[str] = frozenset()
    # of the rows ``df``, the first, those that may hold gate tokens and those that hold none, where plans of their own make them
    apart: tuple[DataFrame, DataFrame, DataFrame] | None = None

    # ---- structure ---------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in RESERVED]

    def gate(self, name: str) -> Gate:
        for g in self.gates:
            if g.name == name:
                return g
        raise KeyError(name)

    def _hidden(self) -> list[str]:
        return [c for c in RESERVED if c in self.df.columns]

    def _with(self, df: DataFrame, same_rows: bool = False, full: DataFrame | None = None, **changes) -> ProvFrame:
        """The frame with other rows; ``full`` are they without its filters."""
        if self.filters and full is None:
            changes.setdefault("filters", ())
            changes["settled"] = changes.get("settled", self.settled) | {"a filter on an aggregate, followed by other than row-wise steps"}
        frame = replace(self, df=df, full=full, whole=self.whole if same_rows else None, **changes)
        kept = {c: t for c, t in frame.tensor_columns.items() if c in df.columns}
        return replace(frame, tensor_columns=kept, frozen=frame.frozen & set(df.columns))

    def _each(self, step: Callable[[DataFrame], DataFrame], same_rows: bool = False, **changes) -> ProvFrame:
        """A step that treats every row alone, taken also by the rows before the filters."""
        full = None if self.full is None else step(self.full)
        return self._with(step(self.df), same_rows, full, **changes)

    def settle(self, what: str) -> ProvFrame:
        """The frame, whose rows depend on a decision that a deletion can't take again."""
        return replace(self, settled=self.settled | {what})

    def plain(self) -> DataFrame:
        """The same query without provenance (Catalyst drops the token columns)."""
        return self.df.select(*self.columns)

    def how(self) -> DataFrame:
        """Result columns plus ``how``: the row's monomial over base and gate tokens."""
        text = mono.monomial_text(PROV)
        if self.conds:
            text = F.concat(text, mono.condition_text(COND))
        return self.df.select(*self.columns, text.alias("how"))

    def circuit(self, *names: str, reachable: bool = False) -> DataFrame:
        """All gates as one long table ``(gate, monomial, coef)``.

        With ``reachable`` only gates that some result row refers to, directly or
        through other gates, are kept.
        """
        gates = [g for g in self.gates if not names or g.name in names]
        tables = self._reachable() if reachable else {g.name: g.derivations for g in self.gates}
        parts = []
        for g in gates:
            text = mono.monomial_text(PROV)
            if g.conds:
                text = F.concat(text, mono.condition_text(COND))
            parts.append(_merged(tables[g.name].select(_GATE, text.alias("monomial")), g.origin.unique))
        return reduce(DataFrame.unionAll, parts)

    def _reachable(self) -> dict[str, DataFrame]:
        """Derivations of every gate, semi-joined to the tokens used above it."""
        users: list[tuple[DataFrame, Mapping[str, tuple[int, int]]]] = [(self.df, self.holds)]
        kept: dict[str, DataFrame] = {}
        for g in reversed(self.gates):
            if g.name == self.whole:
                kept[g.name] = g.derivations
                users.append((g.derivations, g.holds))
                continue
            refs = [
                d.select(F.explode(PROV).alias("__ref")).filter(F.col("__ref").startswith(f"{g.name}["))
                for d, holds in users
                if g.name in holds
            ]
            if refs:
                wanted = distinct_keys(reduce(DataFrame.unionAll, refs), "__ref")
                kept[g.name] = g.derivations.join(wanted, F.col(_GATE) == F.col("__ref"), "left_semi")
            else:
                kept[g.name] = g.derivations.limit(0)
            users.append((kept[g.name], g.holds))
        return kept

    def tensor(self, alias: str, gate: str | None = None) -> DataFrame:
        """Tensor of one aggregate: ``(gate, monomial, value, coef)``, one row per term."""
        g = self.gate(gate) if gate else next(g for g in reversed(self.gates) if alias in g.tensors)
        value = F.col(f"t_{alias}").cast("string").alias("value")
        return _merged(
            g.derivations.select(_GATE, mono.monomial_text(PROV).alias("monomial"), value), g.origin.unique
        )

    def tensor_refs(self) -> ProvFrame:
        """Add ``<alias>_agg`` naming the tensor behind every aggregate column."""
        names = {
            f"{c}_agg": F.coalesce(*[F.concat(mono.gate_ref(g), F.lit(f".{t}")) for g, t in tensors])
            for c, tensors in self.tensor_columns.items()
        }
        return self._each(lambda df: df.withColumns(names), same_rows=True)

    def checkpointed(self) -> ProvFrame:
        """Rows and gates cut off from their lineage, for a frame that is used many times."""
        gates = tuple(replace(g, derivations=checkpointed(g.derivations)) for g in self.gates)
        full = None if self.full is None else checkpointed(self.full)
        return replace(self, df=checkpointed(self.df), gates=gates, full=full)

    # ---- projection and filter --------------------------------------------

    def select(self, *cols: Column | str) -> ProvFrame:
        step = lambda df: df.select(*cols, *self._hidden(), *[c for c in df.columns if c.startswith(HELD)])
        df = step(self.df)
        if any(isinstance(c, Column) for c in cols) and _generates(df):
            self = self._repeated()
        if not self.tensor_columns and not self.frozen:
            return self._each(step, same_rows=True)
        # what is not a column by its name was computed, perhaps from an aggregate
        names = {c for c in cols if isinstance(c, str)}
        names = set(self.columns) if "*" in names else names
        tensors = {c: t for c, t in self.tensor_columns.items() if c in names}
        needed = {c for c, _ in self.derived} & set(df.columns)
        lost = set(self.tensor_columns) - set(df.columns)
        frozen = (set(df.columns) - set(RESERVED) - names) | (needed if lost else set()) | (self.frozen & names)
        derived = () if lost else tuple(x for x in self.derived if x[0] in names)
        return self._each(step, same_rows=True, tensor_columns=tensors, derived=derived, frozen=frozenset(frozen))

    def with_columns(self, **cols: Column) -> ProvFrame:
        """Add or replace columns; next to aggregates they are computed again when these change."""
        self._check_names(cols)
        changed = {c: t for c, t in self.tensor_columns.items() if c not in cols}
        derived, frozen = self.derived, self.frozen
        if self.tensor_columns or frozen:
            replaced = {c for c in cols if c in self.df.columns}
            frozen = frozen | replaced | ({c for c, _ in derived} if replaced & set(self.tensor_columns) else set())
            derived = (*derived, *[(c, e) for c, e in cols.items() if c not in replaced])
        return self._each(
            lambda df: df.withColumns(dict(cols)), same_rows=True, tensor_columns=changed, derived=derived, frozen=frozenset(frozen)
        )

    def filter(self, predicate: Column | str) -> ProvFrame:
        """Rows that satisfy a predicate; on aggregates it is decided again after a deletion."""
        if self.frozen:
            frame = self.settle("a filter beside columns that can't be computed again")
            return frame._each(lambda df: df.filter(predicate))
        if not self.tensor_columns:
            return self._each(lambda df: df.filter(predicate))
        held = held_name()
        full = (self.df if self.full is None else self.full).withColumn(held, F.struct(*self.columns))
        decision = Filter(held, self.tensor_columns, self.derived, predicate)
        return self._with(self.df.filter(predicate), full=full, filters=(*self.filters, decision))

    def rename(self, names: Mapping[str, str]) -> ProvFrame:
        self._check_names(names.values())
        tensors = {names.get(c, c): t for c, t in self.tensor_columns.items()}
        # expressions name the old columns
        used = {c for c, _ in self.derived} if set(names) & set(self.columns) else set()
        frozen = frozenset(names.get(c, c) for c in self.frozen | used)
        derived = () if used else self.derived
        full = None if self.full is None else self.full.withColumnsRenamed(dict(names))
        return replace(
            self, df=self.df.withColumnsRenamed(dict(names)), full=full, tensor_columns=tensors, derived=derived, frozen=frozen
        )

    def to_columns(self, *names: str) -> ProvFrame:
        """Rename all columns by position."""
        if len(names) != len(self.columns):
            raise ValueError(f"{len(names)} names for {len(self.columns)} columns")
        return self.rename(dict(zip(self.columns, names)))

    def prefixed(self, prefix: str) -> ProvFrame:
        """An alias of the table for self-joins: every column gets the prefix."""
        return self.rename({c: prefix + c for c in self.columns})

    @staticmethod
    def _check_names(names) -> None:
        bad = [n for n in names if n in RESERVED or n.startswith(HELD)]
        if bad:
            raise ValueError(f"reserved column names: {bad}")

    # ---- joins -------------------------------------------------------------

    def _merge(self, other: ProvFrame) -> tuple[tuple[Gate, ...], dict[str, tuple[int, int]]]:
        gates = list(self.gates)
        known = {g.name: g for g in gates}
        for g in other.gates:
            if g.name not in known:
                gates.append(g)
            elif known[g.name] is not g:
                raise ValueError(f"two different gates are named {g.name!r}")
        return tuple(gates), dict(self.holds)

    def join(
        self,
        other: ProvFrame,
        on: Sequence[tuple[str, str]],
        how: str = "inner",
        where: Column | None = None,
    ) -> ProvFrame:
        """Join on column pairs plus an optional further condition.

        ``how`` is inner, left or right.  An outer row without a partner keeps its
        own annotation.
        """
        if how not in ("inner", "left", "right"):
            raise ValueError(f"join type {how!r} is not supported")
        if not on:
            raise ValueError("no join keys: use theta_join or cross_join")
        cond = reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in on])
        if self.gates or other.gates:
            cond = cond & own_exchange(self.df, other.df, on)
        if where is not None:
            cond = cond & where
        return self._joined(other, lambda left, right: left.join(right, cond, how), how)

    def lookup(self, table: DataFrame, on: Sequence[tuple[str, str]], unique: bool = False) -> ProvFrame:
        """Widen every row by an unannotated table; the annotation stays.

        State it if the table's keys are ``unique``: else rows may double, and equal terms of
        later sums have to be merged.
        """
        cond = reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in on])
        joined = self._each(lambda df: df.join(table, cond))
        return joined if unique else joined._repeated()

    def _repeated(self) -> ProvFrame:
        """The frame, whose rows may now share a monomial."""
        return replace(self, origin=replace(self.origin, unique=False, flat=False), whole=None)

    def _joined(self, other: ProvFrame, joining: Callable[[DataFrame, DataFrame], DataFrame], how: str = "inner") -> ProvFrame:
        common = set(self.columns) & set(other.columns)
        if common:
            raise ValueError(f"ambiguous columns {sorted(common)}: rename one side first")
        none = F.array().cast("array<string>")

        def joined(left: DataFrame, right: DataFrame) -> DataFrame:
            right = right.withColumnRenamed(PROV, "__prov")
            if COND in right.columns:
                right = right.withColumnRenamed(COND, "__cond")
            df = joining(left, right)
            mine, theirs = F.col(PROV), F.col("__prov")
            if how == "left":
                theirs = F.coalesce(theirs, none)
            elif how == "right":
                mine = F.coalesce(mine, none)
            df = df.withColumn(PROV, F.concat(mine, theirs)).drop("__prov")
            if self.conds or other.conds:
                empty = F.array().cast(mono.COND_TYPE)
                left_c = F.coalesce(F.col(COND), empty) if self.conds else empty
                right_c = F.coalesce(F.col("__cond"), empty) if other.conds else empty
                df = df.withColumn(COND, F.concat(left_c, right_c)).drop("__cond")
            return df

        gates, holds = self._merge(other)
        if how == "right":
            holds = {g: (0, hi) for g, (_, hi) in holds.items()}
        for g, (lo, hi) in other.holds.items():
            a, b = holds.get(g, (0, 0))
            holds[g] = (a + (0 if how == "left" else lo), b + hi)
        settled, filters, full = self.settled | other.settled, (*self.filters, *other.filters), None
        if (other.filters and how == "left") or (self.filters and how == "right"):
            # a row that the filter takes away leaves its partners alone, which a later filter can't say
            settled, filters = settled | {"a filter on an aggregate below the optional side of an outer join"}, ()
        elif filters:
            full = joined(self.df if self.full is None else self.full, other.df if other.full is None else other.full)
        return ProvFrame(
            joined(self.df, other.df),
            gates,
            holds,
            self.width + other.width,
            self.conds + other.conds,
            {**self.tensor_columns, **other.tensor_columns},
            self.origin.with_(other.origin),
            derived=(*self.derived, *other.derived),
            frozen=self.frozen | other.frozen,
            full=full,
            filters=filters,
            settled=settled,
        )

    def _blocked(self, other: ProvFrame, condition: Column | None, order: tuple[str, str, str] | None = None) -> ProvFrame:
        """An equi-join on the cells of a grid, which Spark can spread, broadcast or split.

        Rows of a side lie in one of its blocks and are given to the cells of that block; how many
        blocks a side has follows from the measured sizes, so that the smaller side is copied more
        often, but no side more often than the square root of the number of partitions.  With
        ``order``, (left column, comparison, right column), the left blocks are ranges of the
        left column, and a right row goes only to the ranges that can satisfy the comparison.
        """
        n = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        most = max(1, int(n**0.5))
        if order is None:
            tall, wide = grid(n, *[df.select(F.count(F.lit(1)).cast("double")).scalar() for df in (self.df, other.df)])
            place = lambda size: F.pmod(F.xxhash64(PROV), size).cast("int")

            def joining(left: DataFrame, right: DataFrame) -> DataFrame:
                left = left.withColumn("__li", place(tall)).withColumn("__lj", F.explode(F.sequence(F.lit(0), wide - 1)))
                mine = F.pmod(F.xxhash64("__prov"), wide).cast("int")
                right = right.withColumn("__rj", mine).withColumn("__ri", F.explode(F.sequence(F.lit(0), tall - 1)))
                cond = (F.col("__li") == F.col("__ri")) & (F.col("__lj") == F.col("__rj"))
                return left.join(right, cond if condition is None else cond & condition).drop("__li", "__lj", "__ri", "__rj")

            return self._joined(other, joining)

        x, op, y = order
        mono.flip(op)
        shares = F.array(*[F.lit(i / most) for i in range(1, most)]).cast("array<double>")
        none = F.array().cast(f"array<{dict(self.df.dtypes)[x]}>")
        cuts = self.df.select(F.coalesce(F.percentile_approx(x, shares), none)).scalar() if most > 1 else none

        def joining(left: DataFrame, right: DataFrame) -> DataFrame:
            left = left.filter(F.col(x).isNotNull()).withColumn("__lc", cuts)
            left = left.withColumn("__lb", F.size(F.filter("__lc", lambda c: c <= F.col(x)))).drop("__lc")
            at = lambda i: F.get("__rc", i)
            # block i has values from the i-th cut on and below the next
            above = lambda i: (i == 0) | mono.compare(at(i - 1), "<=" if op == "=" else op, F.col(y))
            below = lambda i: (i == F.size("__rc")) | (at(i) >= F.col(y))
            can = {"<": above, "<=": above, ">": below, ">=": below, "=": lambda i: above(i) & below(i), "<>": lambda i: F.lit(True)}[op]
            right = right.filter(F.col(y).isNotNull()).withColumn("__rc", cuts)
            right = right.withColumn("__rb", F.explode(F.filter(F.sequence(F.lit(0), F.size("__rc")), can))).drop("__rc")
            cond = (F.col("__lb") == F.col("__rb")) & mono.compare(F.col(x), op, F.col(y))
            return left.join(right, cond if condition is None else cond & condition).drop("__lb", "__rb")

        return self._joined(other, joining)

    def theta_join(self, other: ProvFrame, condition: Column | None = None, order: tuple[str, str, str] | None = None) -> ProvFrame:
        """Join on any condition over the columns of both sides, without an equality.

        ``order`` names a comparison between a column of either side that has to hold too; pairs of
        ranges that can't satisfy it are then not formed.
        """
        if condition is None and order is None:
            raise ValueError("no condition: use cross_join")
        return self._blocked(other, condition, order)

    def band_join(self, other: ProvFrame, value: str, low: str, high: str, width) -> ProvFrame:
        """``low <= value <= high``: equi-join on buckets of the given width, then exact check."""
        check = F.col(value).between(F.col(low), F.col(high))

        def joining(left: DataFrame, right: DataFrame) -> DataFrame:
            left = left.withColumn("__lb", F.floor(F.col(value) / F.lit(width)).cast("long"))
            first = F.floor(F.col(low) / F.lit(width)).cast("long")
            last = F.floor(F.col(high) / F.lit(width)).cast("long")
            buckets = F.when(F.col(low) <= F.col(high), F.sequence(first, last))
            right = right.withColumn("__rb", F.explode(buckets))
            return left.join(right, (F.col("__lb") == F.col("__rb")) & check).drop("__lb", "__rb")

        return self._joined(other, joining)

    def cross_join(self, other: ProvFrame) -> ProvFrame:
        return self._blocked(other, None)

    # ---- set operations ----------------------------------------------------

    def union_all(self, other: ProvFrame, allow_missing: bool = False) -> ProvFrame:
        left, right = self.df, other.df
        if self.conds or other.conds:
            empty = F.array().cast(mono.COND_TYPE)
            left = left if self.conds else left.withColumn(COND, empty)
            right = right if other.conds else right.withColumn(COND, empty)
        gates, _ = self._merge(other)
        holds = {}
        for g in {*self.holds, *other.holds}:
            a, b = self.holds.get(g, (0, 0)), other.holds.get(g, (0, 0))
            holds[g] = (min(a[0], b[0]), max(a[1], b[1]))
        tensors = {}
        for c in {**self.tensor_columns, **other.tensor_columns}:
            a, b = self.tensor_columns.get(c, ()), other.tensor_columns.get(c, ())
            if any(g in other.holds for g, _ in set(a) - set(b)) or any(g in self.holds for g, _ in set(b) - set(a)):
                raise ValueError(f"rows of both branches hold tokens of the gate behind {c!r}: its tensor is ambiguous")
            tensors[c] = tuple(dict.fromkeys((*a, *b)))
        conds = tuple(
            tuple(x | y for x, y in zip(a, b)) for a, b in zip_longest(self.conds, other.conds, fillvalue=(frozenset(),) * 2)
        )
        # a column computed in one branch only, or differently, can't be told apart later
        computed = {c for c, _ in (*self.derived, *other.derived)} if tensors else set()
        settled = self.settled | other.settled
        if self.filters or other.filters:
            settled = settled | {"a filter on an aggregate below a union"}
        return ProvFrame(
            left.unionByName(right, allowMissingColumns=allow_missing),
            gates,
            holds,
            max(self.width, other.width),
            conds,
            tensors,
            self.origin.with_(other.origin),
            frozen=self.frozen | other.frozen | computed,
            settled=settled,
        )

    def intersect(self, other: ProvFrame):
        raise ValueError("INTERSECT has no provenance rule here")

    def except_(self, other: ProvFrame):
        raise ValueError("EXCEPT has no provenance rule here")

    # ---- order, top-k, windows --------------------------------------------

    def order_by(self, *cols: Column | str) -> ProvFrame:
        return self._each(lambda df: df.orderBy(*cols), same_rows=True)

    def limit(self, n: int) -> ProvFrame:
        """First rows of the current order; order by a unique key to make it repeatable."""
        return self._with(self.df.limit(n)).settle("a limit")

    def top_per_group(self, keys: Sequence[str], order: Sequence[str], n: int, alias: str = "rank") -> ProvFrame:
        """Rows with ``RANK() <= n`` in the order of columns such as ``"price desc"``.

        Only different values are ranked, at most n of a key: they are counted first, and the counts of
        the values before one make its rank.  Rows are then joined to the ranks, where AQE can split
        any number of ties.
        """
        wanted = [tuple(o.rsplit(" ", 1)) if o.lower().endswith((" desc", " asc")) else (o, "asc") for o in order]
        names = [c for c, _ in wanted]
        sides = [F.desc(c) if way.lower() == "desc" else F.asc(c) for c, way in wanted]
        types = dict(self.df.dtypes)
        values = self.df.groupBy(*keys, *[c for c in names if c not in keys]).agg(F.count(F.lit(1)).alias("__n"))
        first = Window.partitionBy(*keys).orderBy(*sides)
        values = values.withColumn("__at", F.row_number().over(first)).filter(F.col("__at") <= n)
        before = F.coalesce(F.sum("__n").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        values = values.withColumn(alias, (before + 1).cast("int")).filter(F.col(alias) <= n)
        token = mono.gate_token("", [*keys, *names], types)
        ranks = values.select(token.alias("__rk"), alias)
        return self._with(attach(self.df, token, ranks, "inner")).settle("a rank")

    def count_over(self, keys: Sequence[str], alias: str) -> ProvFrame:
        """``COUNT(*) OVER (PARTITION BY keys)`` as a pre-aggregated join, safe for a hot key."""
        token = mono.gate_token("", keys, dict(self.df.dtypes))
        counts = self.df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias)).select(token.alias("__rk"), alias)
        # rows of few keys would fill few partitions, which AQE reads in as few tasks once it broadcasts the counts
        found = counts.agg(F.count(F.lit(1))).scalar()
        salts = F.greatest(F.lit(1), F.ceil(F.lit(SPREAD) / F.greatest(found, F.lit(1)))).cast("int")
        counts = counts.withColumn("__s", F.explode(F.sequence(F.lit(0), salts - 1)))
        counts = counts.select(F.concat_ws("#", "__s", "__rk").alias("__rk"), alias)
        salted = F.concat_ws("#", F.pmod(F.xxhash64(PROV), salts), token)
        return self._with(attach(self.df, salted, counts, "inner")).settle("a count over a partition")


def _merged(terms: DataFrame, unique: bool) -> DataFrame:
    """Equal terms added up into ``coef``."""
    if unique:
        return terms.withColumn("coef", F.lit(1).cast("long"))
    return terms.groupBy(*terms.columns).agg(F.count(F.lit(1)).alias("coef"))


def grid(n: int, left: Column, right: Column) -> tuple[Column, Column]:
    """Blocks of the left and of the right side for about ``n`` cells, by the numbers of rows."""
    most = max(1, int(n**0.5))
    wide = F.least(F.greatest(F.round(F.sqrt(F.lit(n) * right / F.greatest(left, F.lit(1.0)))), F.lit(1)), F.lit(most)).cast("int")
    return F.least(F.lit(most), F.floor(F.lit(n) / wide)).cast("int"), wide


def attach(df: DataFrame, key: Column, per_key: DataFrame, how: str) -> DataFrame:
    """Join one row per key, found in ``__rk``, to every row of ``df``.

    The text key makes the aggregated side shuffle once more on its own, which lets
    AQE broadcast it when its measured size is small and split a hot key of ``df``
    over many tasks otherwise.
    """
    return (
        df.withColumn("__k", key).join(per_key, F.col("__k") == F.col("__rk"), how).drop("__k", "__rk")
    )


def own_exchange(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> Column:
    """A condition that is true wherever the keys are equal, and a join key of its own.

    A grouped side is partitioned by the key already; with one more key the join shuffles it
    anew, and AQE can split a hot key of the other side.
    """
    kinds, others = dict(left.dtypes), dict(right.dtypes)
    wide = {(a, b): "bigint" if {kinds[a], others[b]} <= set(_WHOLE) else kinds[a] for a, b in on if kinds[a] == others[b] or {kinds[a], others[b]} <= set(_WHOLE)}
    if not wide:
        return F.lit(True)
    # hashes differ by type, so both keys take the wider one
    mine = F.xxhash64(*[F.col(a).cast(t) if kinds[a] != t else F.col(a) for (a, _), t in wide.items()])
    return mine == F.xxhash64(*[F.col(b).cast(t) if others[b] != t else F.col(b) for (_, b), t in wide.items()])


def _generates(df: DataFrame) -> bool:
    """Does the last select of a frame make rows out of one?"""
    below = df._jdf.queryExecution().analyzed().children()
    return below.size() > 0 and below.head().getClass().getSimpleName() == "Generate"


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct values of one column, pre-aggregated before they are shuffled.

    Grouping by (hash, key) keeps this shuffle from being taken over by a later join
    on the key, whose own exchange AQE can then measure, broadcast or split.
    """
    return df.select(F.xxhash64(key).alias("__h"), key).distinct().select(key)


def join_all(frames: Sequence[ProvFrame], on: Sequence[tuple[str, str]], where: Column | None = None) -> ProvFrame:
    """Join a list of tables on a list of column equalities, then filter.

    Tables are connected in the given order, each by all equalities it has with the
    ones before it; the physical order is Catalyst's choice.
    """
    done, rest, open_on = frames[0], list(frames[1:]), list(on)
    while rest:
        for f in rest:
            have, new = set(done.columns), set(f.columns)
            pairs = [(a, b) for a, b in open_on if a in have and b in new]
            pairs += [(b, a) for a, b in open_on if b in have and a in new]
            if pairs:
                break
        else:
            raise ValueError("a table has no equality with the tables before it: use theta_join or cross_join")
        rest = [x for x in rest if x is not f]
        open_on = [(a, b) for a, b in open_on if (a, b) not in pairs and (b, a) not in pairs]
        done = done.join(f, pairs)
    for a, b in open_on:
        done = done.filter(F.col(a) == F.col(b))
    return done if where is None else done.filter(where)
