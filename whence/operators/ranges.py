"""Sums over ranges of inner values without pairing outer and inner rows.

``EXISTS (... y > x)`` needs, per outer value x, the sum of all inner rows beyond x.
Written out that is every pair of a key.  Here the inner values of a key are filed in
dyadic intervals: an inner row belongs to one interval per bit level, an outer value
needs at most one or two intervals per level.  So both sides grow by the number of
bits only, and everything is an equi-join on (key, level, interval), which also
spreads a hot key over its intervals.  With several comparisons each interval of one is the key of a
tree of the next: a row is filed once per level of each.

At each node rows that the other side's bounds rule out are dropped, and outer rows that match all inner ones take the node as it is.
Keys with few rows on either side need no tree: their pairs are compared (``few``).

Values without an integer code take their place in the order of all values (``dictionary``), so the
bits are those of the number of different values.  Several comparisons use places among the values of
their key alone (``ranked``): a row is filed once per bit of the number of its key's values.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whence.functions import monomials as mono
from whence.functions.monomials import PROV
from whence.operators.frame import Gate, ProvFrame, distinct_keys
from whence.session import stored

_WHOLE = ("tinyint", "smallint", "int", "bigint")
#: Pairs of outer and inner rows that a key may have to be compared one by one.
FEW = 4096
#: A key's values are dealt to this power of two of blocks for each value, at least.
SPARE = 3


def codes(x: Column, x_type: str, y: Column, y_type: str) -> tuple[Column, Column] | None:
    """Order-preserving 64-bit integers for both sides, or None for other types."""
    if x_type in _WHOLE and y_type in _WHOLE:
        return x.cast("long"), y.cast("long")
    if x_type == y_type == "date":
        return F.unix_date(x).cast("long"), F.unix_date(y).cast("long")
    if x_type == y_type == "timestamp":
        return F.unix_micros(x), F.unix_micros(y)
    a, b = _decimal(x_type), _decimal(y_type)
    if a and b:
        scale = max(a[1], b[1])
        if max(a[0] - a[1], b[0] - b[1]) + scale <= 18:
            shifted = lambda c: (c.cast(f"decimal(18,{scale})") * F.lit(10**scale)).cast("long")
            return shifted(x), shifted(y)
    return None


def _decimal(t: str) -> tuple[int, int] | None:
    found = re.fullmatch(r"decimal\((\d+),(\d+)\)", t)
    return (int(found[1]), int(found[2])) if found else {"int": (10, 0), "smallint": (5, 0), "tinyint": (3, 0)}.get(t)


@dataclass(frozen=True)
class Places:
    """Integers of the same order for a column of either side; ``last`` is above all of them, 0 below."""

    outer: Column
    inner: Column
    last: Column

    def sides(self, op: str, loose: bool) -> tuple[Column, Column]:
        """Both sides of a comparison; if it is ``loose``, NULLs are where it holds."""
        if not loose:
            return self.outer, self.inner
        ends = (F.lit(0), self.last) if op in ("<", "<=", "<>") else (self.last, F.lit(0))
        return F.coalesce(self.outer, ends[0]), F.coalesce(self.inner, ends[1])


@dataclass(frozen=True)
class Ranks:
    """Places from 1 in the order of a key's values of either side, and for each side the place above them."""

    outer: Column
    inner: Column
    outer_last: Column
    inner_last: Column

    def sides(self, op: str, loose: bool) -> tuple[Column, Column]:
        """Both sides of a comparison; if it is ``loose``, NULLs are where it holds."""
        if not loose:
            return self.outer, self.inner
        zero = F.lit(0).cast("long")
        ends = (zero, self.inner_last) if op in ("<", "<=", "<>") else (self.outer_last, zero)
        return F.coalesce(self.outer, ends[0]), F.coalesce(self.inner, ends[1])

    def bits(self) -> tuple[Column, Column]:
        return F.length(F.bin(self.outer_last)), F.length(F.bin(self.inner_last))


def coded(asking: DataFrame, given: DataFrame, pairs: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame, dict[tuple[str, str], Places]]:
    """Both sides, where needed with further columns, and the places of each pair's values."""
    places = {}
    for i, (x, y) in enumerate(pairs):
        pair = codes(F.col(x), dict(asking.dtypes)[x], F.col(y), dict(given.dtypes)[y])
        if pair is not None and len(pairs) == 1:
            places[x, y] = Places(*pair, F.lit(None))
            continue
        values = dictionary(asking.select(F.col(x).alias("v")).distinct().unionAll(given.select(F.col(y).alias("v")).distinct()))
        asking, given = _looked_up(asking, x, values, f"__xc{i}"), _looked_up(given, y, values, f"__yc{i}")
        last = values.agg(F.coalesce(F.max("code"), F.lit(0)) + 1).scalar()
        places[x, y] = Places(F.col(f"__xc{i}"), F.col(f"__yc{i}"), last)
    return asking, given, places


def ranked(
    asking: DataFrame, given: DataFrame, on: Sequence[tuple[str, str]], pairs: Sequence[tuple[str, str]]
) -> tuple[DataFrame, DataFrame, dict[tuple[str, str], Ranks]]:
    """Both sides with further columns, and of each pair the places among the values of one key."""
    places = {}
    keys = [f"__q{i}" for i in range(len(on))]
    for i, (x, y) in enumerate(pairs):
        mine = asking.select(*[F.col(a).alias(q) for (a, _), q in zip(on, keys)], F.col(x).alias("v"))
        theirs = given.select(*[F.col(b).alias(q) for (_, b), q in zip(on, keys)], F.col(y).alias("v"))
        values = dictionary(mine.distinct().unionAll(theirs.distinct()), keys)
        asking = _ranks(asking, [a for a, _ in on], x, values, f"__x{i}")
        given = _ranks(given, [b for _, b in on], y, values, f"__y{i}")
        places[x, y] = Ranks(F.col(f"__x{i}c"), F.col(f"__y{i}c"), F.col(f"__x{i}l"), F.col(f"__y{i}l"))
    return asking, given, places


def _ranks(df: DataFrame, on: Sequence[str], column: str, values: DataFrame, name: str) -> DataFrame:
    """``df`` with the place of its value in its key, ``<name>c``, and the place after the key's last, ``<name>l``."""
    values = values.withColumnsRenamed({"v": "__v", "code": "__c"})
    kinds, keys = dict(values.dtypes), [f"__q{i}" for i in range(len(on))]

    def joined(rows: DataFrame, right: DataFrame, names: Sequence[str], own: Sequence[str]) -> DataFrame:
        # hashed in the values' types; one more key, as in ``_looked_up``
        same = reduce(Column.__and__, [F.col(c) == F.col(n) for c, n in zip(own, names)])
        mine = F.xxhash64(*[F.col(c).cast(kinds[n]) for c, n in zip(own, names)])
        return rows.join(right.withColumn("__h", F.xxhash64(*names)), same & (mine == F.col("__h")), "left").drop("__h", *names)

    df = joined(df, values, [*keys, "__v"], [*on, column])
    spans = values.groupBy(*keys).agg((F.min("__c") - 1).alias("__first"), F.max("__c").alias("__most"))
    df = joined(df, spans, keys, on) if on else df.crossJoin(spans)
    last = F.coalesce(F.col("__most") - F.col("__first"), F.lit(0).cast("long")) + 1
    return df.withColumns({f"{name}c": F.col("__c") - F.col("__first"), f"{name}l": last}).drop("__c", "__first", "__most")


def _looked_up(df: DataFrame, column: str, values: DataFrame, name: str) -> DataFrame:
    # one more key: the values' exchange is their own, and a value with very many rows can be split
    hashed = values.select(F.col("v").alias("__v"), F.xxhash64("v").alias("__h"), F.col("code").alias(name))
    found = df.join(hashed, (F.col(column) == F.col("__v")) & (F.xxhash64(F.col(column)) == F.col("__h")), "left")
    return found.drop("__v", "__h")


def dictionary(values: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(v, code): every value with its place, from 1, in the order of the different ones; with ``keys`` in that of (keys, v).

    Values are dealt to ranges and numbered there; the ranges' sizes, as many as there are partitions, are added up.
    The numbered values are a table in the shared folder: dealt anew, they could fall into other ranges.
    """
    ordered = values.filter("v is not null").distinct().repartitionByRange(*keys, "v").sortWithinPartitions(*keys, "v")
    ordered = stored(ordered.withColumn("id", F.monotonically_increasing_id()), "order")
    ranged = ordered.withColumn("part", F.shiftright("id", 33))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranged.join(starts, F.col("part") == F.col("p")).select(*keys, "v", (F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("code"))


def some_match(op: str, x: Column, low: Column, high: Column) -> Column:
    """Is there a y between low and high (both attained) with ``x op y``?"""
    return {
        "<": lambda: x < high,
        "<=": lambda: x <= high,
        ">": lambda: x > low,
        ">=": lambda: x >= low,
        "=": lambda: (x == low) | (x == high),
        "<>": lambda: (low != x) | (high != x),
    }[op]()


def few(
    outer: ProvFrame, inner: ProvFrame, on: Sequence[tuple[str, str]], token: Column, residual: Sequence, either: Sequence[Sequence]
) -> tuple[DataFrame | None, tuple[ProvFrame, ProvFrame] | None]:
    """(gate, prov) of the matches of keys with few rows, compared pair by pair; the rows of the other keys, None if there are none.

    A key has at most ``FEW`` such pairs, so a few for each of its rows, and the rows meet in one shuffle by key.
    """
    tests = [*residual, *[t for g in either for t in g]]
    xs, ys = (list(dict.fromkeys(t[i] for t in tests)) for i in (0, 2))
    outer_keys, inner_keys = [a for a, _ in on], [b for _, b in on]
    mine = (outer.df if outer.full is None else outer.full).select(*dict.fromkeys([*outer_keys, *xs]))
    theirs = inner.df.select(*inner._hidden(), *dict.fromkeys([*inner_keys, *ys]))
    # read to count, to compare and to tell who has matches
    mine, theirs = stored(mine.dropna(subset=outer_keys) if on else mine, "asked"), stored(theirs.dropna(subset=inner_keys) if on else theirs, "filed")
    keys = [f"__q{i}" for i in range(len(on))]
    kinds, others = dict(mine.dtypes), dict(theirs.dtypes)
    wide = [kinds[a] if kinds[a] == others[b] else "bigint" for a, b in on]
    keyed = lambda df, names: df.select("*", *[F.col(c).cast(t).alias(q) for c, t, q in zip(names, wide, keys)])
    mine, theirs = keyed(mine, outer_keys), keyed(theirs, inner_keys)

    crowded, far = _crowded(mine, theirs, keys), None
    if not crowded.isEmpty():
        if not on:
            return None, (replace(outer, df=mine, full=None), replace(inner, df=theirs))
        many = reduce(Column.__and__, [F.col(q) == F.col(f"__c{i}") for i, q in enumerate(keys)])
        split = lambda df, how: df.join(crowded, many, how)
        far = (replace(outer, df=split(mine, "left_semi").drop(*keys), full=None), replace(inner, df=split(theirs, "left_semi").drop(*keys)))
        mine, theirs = split(mine, "left_anti"), split(theirs, "left_anti")
    # dealt by key alone, which serves to tell equal rows and to meet
    asked = (mine.repartition(*keys) if on else mine).distinct().withColumn("gate", token)
    asked = asked.select("gate", *[F.col(q).alias(f"__p{i}") for i, q in enumerate(keys)], *[F.col(x).alias(f"__x{i}") for i, x in enumerate(xs)])
    filed = theirs.select(*inner._hidden(), *keys, *[F.col(y).alias(f"__y{i}") for i, y in enumerate(ys)])
    holds = lambda ts: reduce(Column.__and__, [mono.compare(F.col(f"__x{xs.index(x)}"), op, F.col(f"__y{ys.index(y)}")) for x, op, y in ts])
    wanted = [F.col(f"__p{i}") == F.col(q) for i, q in enumerate(keys)] + ([holds(residual)] if residual else [])
    if either:
        wanted.append(reduce(Column.__or__, [holds(g) for g in either]))
    return asked.join(filed, reduce(Column.__and__, wanted)).select("gate", PROV), far


def _crowded(mine: DataFrame, theirs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than ``FEW`` pairs; rows are counted before the shuffle."""
    counts = [df.select(*keys, F.lit(a).alias("a"), F.lit(b).alias("b")) for df, a, b in ((mine, 1, 0), (theirs, 0, 1))]
    sums = counts[0].unionAll(counts[1]).groupBy(*keys).agg(F.sum("a").cast("double").alias("a"), F.sum("b").alias("b"))
    return stored(sums.filter(F.col("a") * F.col("b") > FEW).select(*[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)], F.lit(True).alias("many")), "crowded")


def box_gates(
    params: DataFrame, inner: ProvFrame, inside: DataFrame, name: str, ops: Sequence[str], keys: int, carry: Sequence[str] = ()
) -> tuple[DataFrame, Gate, DataFrame]:
    """(derivations of the outer gates, the gate ``name`` of tree nodes, outer gates that have any) of ``x0 op0 y0 and x1 op1 y1 ...``.

    ``params`` has (gate, __x0.., __k0..), one row per outer key and codes; ``inside`` has
    (__y0.., __j0.., prov), one row per inner row.  A node is named by the key, then level and interval of every comparison.
    Ranks come with their bits, ``__xd0..`` and ``__yd0..``; other codes lie in the range of all inner values.
    The last comparison needs no tree to tell which outer gates have derivations: the bounds of a node do.
    """
    text = lambda side, kinds: mono.key_text([f"__{side}{i}" for i in range(keys)], kinds)
    params = params.withColumn("__key", text("k", dict(params.dtypes)))
    inside = inside.withColumn("__key", text("j", dict(inside.dtypes)))
    hits = params
    for i, op in enumerate(ops):
        ranks = f"__xd{i}" in params.columns
        x, y = f"__x{i}", f"__y{i}"
        bounded = bool(keys or i) and ranks
        if bounded:
            params, inside = _bounded(params, inside, x, y, op)
            # each level reads both sides several times
            params, inside = stored(params, "asked"), stored(inside, "filed")
            hits = params
        elif i == len(ops) - 1:
            bounds = inside.groupBy("__key").agg(F.min(y).alias("__low"), F.max(y).alias("__high"))
            bounds = bounds.select(F.concat("__key", F.lit("")).alias("__rk"), "__low", "__high")
            hits = params.join(bounds, F.col("__key") == F.col("__rk")).filter(some_match(op, F.col(x), F.col("__low"), F.col("__high")))
        node = lambda: F.concat_ws("|", F.when(F.lit(bool(keys or i)), F.col("__key")), F.col("__b"), F.col("__p"))  # noqa: B023, E731
        if keys and not i and not ranks:
            params, inside = _met(params, inside, x, y, op)
            params, inside = (df.withColumn("__key", node()).drop("__b", "__p") for df in (params, inside))
            continue
        # levels 0 .. depth-1 tell inner values apart; level ``depth`` is the whole range, in which all ranks are
        if ranks:
            params = params.withColumns({"__lo": F.lit(0).cast("long"), "__hi": F.lit(0).cast("long"), "__d": F.col(f"__xd{i}")}).drop(f"__xd{i}")
            inside = inside.withColumn("__d", F.col(f"__yd{i}")).drop(f"__yd{i}")
        else:
            ends = inside.agg(F.coalesce(F.min(y), F.lit(0)).alias("lo"), F.coalesce(F.max(y), F.lit(0)).alias("hi"))
            bits = F.least(F.length(F.bin(F.col("lo").bitwiseXOR(F.col("hi")))), F.lit(63))
            ends = ends.select(F.struct("lo", "hi", bits.alias("d")).alias("ends")).scalar()
            params = params.withColumns({"__lo": ends["lo"], "__hi": ends["hi"], "__d": ends["d"]})
            inside = inside.withColumn("__d", ends["d"])
        params = params.withColumn("__x", F.col(x))
        asked, filed = _intervals(op), _levels(op, whole=not ranks)
        if bounded:  # level -1 is the whole node
            asked = F.when(F.col("__all"), F.expr("array(named_struct('b', -1, 'p', 0L))")).otherwise(asked)
            none = F.array().cast("array<int>")
            filed = F.concat(F.when(F.col("__some"), filed).otherwise(none), F.when(F.col("__whole"), F.array(F.lit(-1))).otherwise(none))
        params = params.withColumn("__n", F.explode(asked)).withColumns({"__b": F.col("__n.b"), "__p": F.col("__n.p")})
        params = params.withColumn("__key", node()).drop("__lo", "__hi", "__d", "__x", "__n", "__b", "__p", "__all", x)
        inside = inside.withColumn("__y", F.col(y)).withColumn("__b", F.explode(filed))
        inside = inside.withColumn("__p", F.expr("if(__b < 0, 0L, shiftright(__y, __b))")).withColumn("__key", node())
        inside = inside.drop("__d", "__b", "__p", "__y", "__some", "__whole", y)
    if not ops:
        hits = params.join(distinct_keys(inside.select(F.concat("__key", F.lit("")).alias("__have")), "__have"), F.col("__key") == F.col("__have"), "left_semi")
    named = lambda: F.concat(F.lit(f"{name}["), "__key", F.lit("]"))
    asked, rows = params.select("gate", named().alias("__node")), inside.select(named().alias("gate"), *inner._hidden(), *carry)
    wanted = distinct_keys(asked.select("__node"), "__node")
    members = rows.join(wanted, F.col("gate") == F.col("__node"), "left_semi")
    present = distinct_keys(rows.select(F.col("gate").alias("__have")), "__have")
    parts = asked.join(present, F.col("__node") == F.col("__have"), "left_semi").select("gate", F.array("__node").alias(PROV))
    gate = Gate(name, members, {}, False, True, dict(inner.holds), inner.width, inner.conds, inner.origin)
    return parts, gate, hits.select("gate")


def _bounded(params: DataFrame, inside: DataFrame, x: str, y: str, op: str) -> tuple[DataFrame, DataFrame]:
    """The rows of either side for which some row of the other one can match, by the bounds of their key.

    An outer row that matches all of a key's inner ones (``__all``) asks for its whole node; inner rows are told if some outer row
    does (``__whole``), and if some does not (``__some``).
    """
    found = inside.groupBy("__key").agg(F.min(y).alias("__low"), F.max(y).alias("__high"))
    found = found.select(F.concat("__key", F.lit("")).alias("__rk"), "__low", "__high")
    every = {"<": F.col(x) < F.col("__low"), "<=": F.col(x) <= F.col("__low"), ">": F.col(x) > F.col("__high"), ">=": F.col(x) >= F.col("__high")}
    every["<>"] = every["<"] | every[">"]
    params = params.join(found, F.col("__key") == F.col("__rk")).filter(some_match(op, F.col(x), F.col("__low"), F.col("__high")))
    params = params.withColumn("__all", every[op]).drop("__rk", "__low", "__high")
    asking = params.groupBy("__key").agg(F.min(x).alias("__low"), F.max(x).alias("__high"), F.max("__all").alias("__whole"), (~F.min("__all")).alias("__some"))
    asking = asking.select(F.concat("__key", F.lit("")).alias("__rk"), "__low", "__high", "__whole", "__some")
    inside = inside.join(asking, F.col("__key") == F.col("__rk")).filter(some_match(mono.flip(op), F.col(y), F.col("__low"), F.col("__high")))
    return params, inside.drop("__rk", "__low", "__high")


def _met(params: DataFrame, inside: DataFrame, x: str, y: str, op: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of ``x op y`` filed as by ``_intervals`` and ``_levels``, as (__b, __p), but only where the other side of the key can be.

    Codes have the bits of all values, of which a key's few need not many to be told apart.  So its values are dealt to blocks,
    some for each value, and an interval is kept if it lies between the other side's least and greatest value: of the key, for
    intervals of a block or more, and of the block below that.  Most values are alone in their block.
    """
    one = F.count(F.lit(1))
    mine = params.groupBy("__key").agg(F.min(x).alias("__olo"), F.max(x).alias("__ohi"), one.alias("__on"))
    theirs = inside.groupBy("__key").agg(F.min(y).alias("__ilo"), F.max(y).alias("__ihi"), one.alias("__in")).withColumnRenamed("__key", "__rk")
    bits = lambda c: F.length(F.bin(c))
    apart = bits(F.least("__olo", "__ilo").bitwiseXOR(F.greatest("__ohi", "__ihi")))
    block = F.greatest(F.lit(0), F.least(apart, F.lit(63)) - bits(F.col("__on") + F.col("__in")) - SPARE)
    spans = mine.join(theirs, F.col("__key") == F.col("__rk")).select(F.concat("__rk", F.lit("")).alias("__rk"), "__olo", "__ohi", "__ilo", "__ihi", block.alias("__c"))

    def spanned(df: DataFrame, value: str, side: str) -> DataFrame:
        found = spans.select("__rk", F.col(f"__{side}lo").alias("__lo"), F.col(f"__{side}hi").alias("__hi"), "__c")
        found = df.join(found, F.col("__key") == F.col("__rk")).drop("__rk")
        return found.withColumn("__block", F.expr(f"shiftright({value}, __c)"))

    def blocked(df: DataFrame, other: DataFrame, value: str) -> DataFrame:
        # one more key, as in ``_looked_up``
        found = other.groupBy("__key", "__block").agg(F.min(value).alias("__blo"), F.max(value).alias("__bhi"))
        found = found.select(F.col("__key").alias("__rk"), F.col("__block").alias("__rb"), F.xxhash64("__key", "__block").alias("__h"), "__blo", "__bhi")
        same = (F.col("__key") == F.col("__rk")) & (F.col("__block") == F.col("__rb")) & (F.xxhash64("__key", "__block") == F.col("__h"))
        return df.join(found, same, "left").drop("__rk", "__rb", "__h", "__block")

    params, inside = spanned(params, x, "i"), spanned(inside, y, "o")
    asked, filed = blocked(params, inside, y), blocked(inside, params, x)

    # levels 0 .. depth-1 tell inner values apart; level ``depth`` is the whole range
    ends = spans.agg(F.coalesce(F.min("__ilo"), F.lit(0)).alias("lo"), F.coalesce(F.max("__ihi"), F.lit(0)).alias("hi"))
    deep = F.least(F.length(F.bin(F.col("lo").bitwiseXOR(F.col("hi")))), F.lit(63))
    ends = ends.select(F.struct("lo", "hi", deep.alias("d")).alias("ends")).scalar()
    own, side = op in ("<=", ">="), {"<": 1, "<=": 1, ">": 0, ">=": 0}.get(op)

    def levels(df: DataFrame, first: int) -> DataFrame:
        """A row for each level that may hold something: below the block only if there is anything in it."""
        lowest = F.when(F.col("__blo").isNull(), F.least("__c", "__d")).otherwise(F.lit(first))
        df = df.withColumns({"__first": ends["lo"], "__last": ends["hi"], "__d": ends["d"]})
        df = df.withColumns({c: F.expr(f"shiftright({c}, __d)") for c in ("__first", "__last")})
        return df.withColumn("__b", F.explode(F.sequence(lowest, F.col("__d"))))

    def near(p: str) -> str:
        within = lambda lo, hi: f"{p} between shiftright({lo}, __b) and shiftright({hi}, __b)"
        return f"if(__b >= __c, {within('__lo', '__hi')}, {within('__blo', '__bhi')})"

    # level -1 stands for x itself
    asked = levels(asked, -1 if own else 0).withColumn("__own", F.col("__b") < 0).withColumn("__b", F.greatest("__b", F.lit(0)))
    asked = asked.withColumn("__at", F.expr(f"shiftright({x}, __b)"))
    outside = {"<": "__at < __last", ">": "__at > __first"}
    place = F.expr(f"case when __own then {x} when __b < __d then __at ^ 1 when {outside['<']} then __last else __first end")
    beside = near("(__at ^ 1)") + ("" if side is None else f" and __at & 1 = {1 - side}")
    whole = outside.get(op.rstrip("="), " or ".join(outside.values()))
    asked = asked.withColumn("__p", place).filter(f"case when __own then {near(x)} when __b < __d then {beside} else {whole} end")

    filed = levels(filed, 0).withColumn("__p", F.expr(f"shiftright({y}, __b)"))
    beside = near("(__p ^ 1)") + ("" if side is None else f" and __p & 1 = {side}")
    kept = f"if(__b = __d, shiftright(__lo, __d) <> __p or shiftright(__hi, __d) <> __p, {beside})"
    filed = filed.filter(f"{kept} or __b = 0 and {near('__p')}" if own else kept)
    used = ("__lo", "__hi", "__blo", "__bhi", "__c", "__d", "__first", "__last", "__own", "__at", x, y)
    return asked.drop(*used), filed.drop(*used)


def _levels(op: str, whole: bool) -> Column:
    """Array of the levels at which an inner value is filed: where ``_intervals`` can ask for its interval.

    What is above x lies in right neighbours, which are odd, what is below in left ones.
    """
    side = {"<": 1, "<=": 1, ">": 0, ">=": 0}.get(op)
    wanted = [] if side is None else [f"(shiftright(__y, b) & 1) = {side}"]
    if wanted and op in ("<=", ">="):
        wanted.append("b = 0")
    levels = "sequence(0, __d - 1)"
    if wanted:
        levels = f"filter({levels}, b -> {' or '.join(wanted)})"
    return F.expr(f"concat({levels}, array(__d))" if whole else levels)


def _intervals(op: str) -> Column:
    """Array of (b, p): the intervals that make up ``{y : x op y}``.

    At each level the neighbour of x's own interval on the wanted side, and at the top
    the whole range if x lies outside it.  Intervals nobody is in are dropped later.
    """
    above = """concat(
        transform(filter(sequence(0, __d - 1), b -> (shiftright(__x, b) & 1) = 0),
                  b -> named_struct('b', b, 'p', shiftright(__x, b) + 1)),
        filter(array(named_struct('b', __d, 'p', shiftright(__hi, __d))), n -> shiftright(__x, __d) < n.p))"""
    below = """concat(
        transform(filter(sequence(0, __d - 1), b -> (shiftright(__x, b) & 1) = 1),
                  b -> named_struct('b', b, 'p', shiftright(__x, b) - 1)),
        filter(array(named_struct('b', __d, 'p', shiftright(__lo, __d))), n -> shiftright(__x, __d) > n.p))"""
    own = "array(named_struct('b', 0, 'p', __x))"
    parts = {"<": [above], ">": [below], "<=": [above, own], ">=": [below, own], "<>": [above, below]}[op]
    return F.expr(f"concat({', '.join(parts)})")
