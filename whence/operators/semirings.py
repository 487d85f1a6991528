"""Expanded polynomials and the coarser forms of provenance.

Polynomials are kept long: ``(out, m, c)`` with one row per monomial, ``out`` naming
the result row.  Each form is one projection and one grouping on (out, monomial), so
a result row with very many derivations spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.functions import monomials as mono
from whence.functions.monomials import PROV
from whence.operators.frame import Gate, ProvFrame
from whence.session import stored

#: Witnesses that are filed under one token, before they are filed under two.
CROWDED = 32
#: Terms that a task makes of one gate token, about, where an expansion is spread.
BLOCK = 1 << 20
#: Terms of a gate that are packed into one array, about, where sums are multiplied.
PACKED = 64
#: Rows that one copy of such an array meets, about.
MEETING = 4


@dataclass(frozen=True)
class Polynomials:
    """``terms`` has (out, m, c), and ``text`` if the expansion was asked for it; ``flat`` says that no token repeats within a monomial."""

    terms: DataFrame
    delta: bool = False
    flat: bool = False

    def how(self) -> DataFrame:
        """N[X]: coefficients and exponents kept."""
        return self.terms

    def boolean(self) -> DataFrame:
        """B[X]: coefficients dropped, exponents kept."""
        return self.terms.select("out", "m").withColumn("c", F.lit(1).cast("long"))

    def trio(self) -> DataFrame:
        """Trio(X): exponents dropped, coefficients of equal terms added."""
        if self.flat:
            return self.terms
        return (
            self.terms.select("out", mono.support("m").alias("m"), "c").groupBy("out", "m").agg(F.sum("c").alias("c"))
        )

    def why(self) -> DataFrame:
        """Why(X): the set of witness sets."""
        if self.flat:
            return self.terms.select("out", "m")
        return self.terms.select("out", mono.support("m").alias("m")).distinct()

    def posbool(self) -> DataFrame:
        """PosBool(X): witnesses that contain no other witness of the same row."""
        # a table: it is read several times, and its rows keep their numbers
        w = stored(self.why().withColumns({"id": F.monotonically_increasing_id(), "__size": F.size("m")}), "witnesses")
        return w.join(_absorbed(w).distinct().toDF("__id"), F.col("id") == F.col("__id"), "left_anti").select("out", "m")

    def lineage(self) -> DataFrame:
        """Lin(X): every token that occurs, as ``(out, token)``."""
        return self.terms.select("out", F.explode("m").alias("token")).distinct()

    def texts(self, *kinds: str) -> DataFrame:
        """Display text, one row per term: ``(out, form, term, coef, delta)``.

        ``delta`` says that the row's polynomial stands under δ.  Forms that keep the terms apart are one pass over
        them, trio, why and lineage another; posbool compares witnesses.
        """
        kinds = kinds or ("how",)
        if unknown := set(kinds) - set(_TEXT):
            raise ValueError(f"unknown forms {sorted(unknown)}")
        one = lambda kind, m: F.struct(F.lit(kind).alias("form"), m.alias("m"))

        def view(*read: Column) -> DataFrame:
            return self.terms.select("out", F.explode(F.concat(*read)).alias("x"), "c").select("out", "x.form", "x.m", "c")

        # terms differ, so only supports and tokens can repeat; trio and why are the same supports
        each = [k for k in kinds if k in (("how", "boolean", "trio", "why") if self.flat else ("how", "boolean"))]
        same = [k for k in kinds if k in ("trio", "why") and k not in each]
        parts = [view(F.array(*[one(k, F.col("m")) for k in each]))] if each else []
        merged = [F.array(one("same", mono.support("m")))] if same else []
        if "lineage" in kinds:
            merged.append(F.transform(F.array_distinct("m"), lambda t: one("lineage", F.array(t))))
        if merged:
            rows = view(*merged).groupBy("out", "form", "m").agg(F.sum("c").alias("c"))
            named = F.when(F.col("form") == "same", F.array(*[F.lit(k) for k in same]).cast("array<string>")).otherwise(F.array("form"))
            parts.append(rows.select("out", F.explode(named).alias("form"), "m", "c"))
        if "posbool" in kinds:
            parts.append(self.posbool().select("out", F.lit("posbool").alias("form"), "m", F.lit(1).cast("long").alias("c")))
        rows = reduce(DataFrame.unionAll, parts)
        counted = F.col("form").isin("how", "trio")
        text = F.lit(None).cast("string")
        for kind in kinds:
            text = F.when(F.col("form") == kind, _TEXT[kind](F.col("m"))).otherwise(text)
        coef = F.when(counted, F.col("c")).otherwise(F.lit(1).cast("long"))
        delta = (F.col("form") == "how") & F.lit(self.delta)
        return rows.select("out", "form", text.alias("term"), coef.alias("coef"), delta.alias("delta"))


def _conjunction(m: Column) -> Column:
    text = F.array_join(m, mono.AND)
    return F.when(F.size(m) > 1, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


_TEXT = {
    "how": mono.monomial_text,
    "boolean": mono.monomial_text,
    "trio": mono.monomial_text,
    "why": lambda m: F.concat(F.lit("{"), F.array_join(m, ","), F.lit("}")),
    "posbool": _conjunction,
    "lineage": lambda m: F.get(m, F.lit(0)),
}


def _absorbed(w: DataFrame) -> DataFrame:
    """Numbers of the witnesses of which a proper subset is a witness of the same row too.

    Only a witness shorter than the longest can absorb.  It is filed under the token that the fewest of these have, and under a
    second one too where more than ``CROWDED`` have the same first.  A subset of a witness is filed under the witness's own
    tokens, so each looks only there; a token that all witnesses share is never what brings two together.
    The look-ups join on hashes, and compare rows and tokens; AQE can split a token that is in very many.
    """
    _, asking, filed = _lookups(w)
    inside = (F.col("out") == F.col("__o")) & (F.col("__s") < F.size("m")) & F.forall("__w", lambda t: F.array_contains("m", t))
    return asking.join(filed, (F.col("__k2") == F.col("__f2")) & inside, "left_semi").select("id")


def _again(key: str) -> Column:
    # another key than that of the grouping: the join has an exchange of its own, which AQE can split
    return F.xxhash64(key)


def _lookups(w: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(__rk, __n, __least) of tokens under which something is filed; (columns of w, __k2): who looks where; (__f2, __o, __w, __s): what is there."""
    if "__size" not in w.columns:
        w = w.withColumn("__size", F.size("m"))
    size, lengths = F.col("__size"), w.agg(F.struct(F.min("__size").alias("least"), F.max("__size").alias("most"))).scalar()
    short = w.filter(size < lengths["most"]).select(F.col("out").alias("__o"), F.col("m").alias("__w"), size.alias("__s"))
    several = short.filter("__s > 1")
    tokens = several.withColumn("t", F.explode("__w")).withColumn("__f", F.xxhash64("__o", "t"))
    rarity = tokens.groupBy("__f").agg(F.count(F.lit(1)).alias("n")).select(_again("__f").alias("__rk"), "n")
    first = tokens.join(rarity, _again("__f") == F.col("__rk")).groupBy("__o", "__w").agg(F.min(F.struct("n", "t"))["t"].alias("t"))
    alone = short.filter("__s = 1").select("__o", "__w", F.get("__w", F.lit(0)).alias("t"))
    filed = stored(alone.unionAll(first).select("*", F.size("__w").alias("__s"), F.xxhash64("__o", "t").alias("__f")), "filed")

    counts = filed.groupBy("__f").agg(F.count(F.lit(1)).alias("__n"), F.min("__s").alias("__least"))
    buckets = counts.select(_again("__f").alias("__rk"), "__n", "__least")
    held = filed.join(buckets.select("__rk", "__n"), _again("__f") == F.col("__rk")).drop("__rk")
    apart = (F.col("__s") > 1) & (F.col("__n") > CROWDED)
    pairs = held.filter(apart).withColumn("u", F.explode("__w")).filter("u <> t")
    pairs = pairs.join(rarity, F.xxhash64(F.xxhash64("__o", "u")) == F.col("__rk")).groupBy("__o", "__w", "__s", "__f").agg(F.min(F.struct("n", "u"))["u"].alias("u"))
    there = held.filter(~apart).select(F.col("__f").alias("__f2"), "__o", "__w", "__s")
    there = there.unionAll(pairs.select(F.xxhash64("__f", "u").alias("__f2"), "__o", "__w", "__s"))

    wider = w.filter(size > lengths["least"])
    wider = wider.withColumn("t", F.explode("m")).withColumn("__k", F.xxhash64("out", "t")).drop("t")
    asking = wider.join(buckets, (_again("__k") == F.col("__rk")) & (F.col("__least") < size))
    more = F.when(F.col("__n") > CROWDED, F.transform("m", lambda u: F.xxhash64(F.col("__k"), u))).otherwise(F.array().cast("array<bigint>"))
    return buckets, asking.select(*w.columns, F.explode(F.concat(F.array("__k"), more)).alias("__k2")), there


def expand(frame: ProvFrame, only: str | None = None, spread: bool = False, packed: bool = False, text: bool = False, by: Column | None = None) -> Polynomials:
    """Replace gate tokens by their derivations, outermost first, until base tokens are left.

    ``out`` is the row's own monomial as printed by ``how()``.  With ``only`` the
    polynomials of that gate's tokens are expanded instead of the result rows.  ``spread`` counts
    beforehand how many terms each token will make, and deals those of many to several tasks.
    ``packed`` is for products of sums: what is shuffled are blocks of terms, which are multiplied out last.
    With ``text`` terms have their monomial's display text too, which is made once for each derivation where it is a term alone.
    ``by``, made of ``out``, takes its place: polynomials of rows with the same value are added up.  Equal terms are counted
    before every look-up, so what many rows have in common is looked up once.
    """
    if by is not None and (spread or packed):
        raise ValueError("terms that are added up are not spread")
    ready = None
    if only is None and frame.whole is not None:
        # every group is a result row: its gate token names it, no look-up is needed
        only = frame.whole
    if only is None:
        # rows with the same annotation have the same polynomial, which is expanded once
        same = (lambda df: df) if frame.origin.unique else DataFrame.distinct
        named = lambda df: same(df.select(mono.monomial_text(PROV).alias("out"), F.sort_array(PROV).alias("m")))
        if packed and frame.apart is not None and frame.apart[0] is frame.df:  # rows without gates need not be made to look for them
            start, ready = (named(df) for df in frame.apart[1:])
        else:
            start = named(frame.df)
        holds, delta, flat = dict(frame.holds), False, frame.origin.flat
        if len(holds) == 1 and frame.gates:
            (top,) = holds
            delta = frame.gate(top).delta
    else:
        gate = frame.gate(only)
        start = gate.derivations.select(F.col("gate").alias("out"), F.col(PROV).alias("m"))
        holds, delta, flat = dict(gate.holds), gate.delta, gate.origin.flat
    if by is not None:
        start = _counted(start.select(by.alias("out"), "m", F.lit(1).cast("long").alias("n")))
    t, shown = start, False
    factors = []
    for gate in reversed(frame.gates):
        low, high = holds.pop(gate.name, (0, 0))
        if packed and high == 1 and not gate.holds and gate.origin.unique:
            factors.append(gate)
            continue
        for i in range(high):
            t, shown = _inline(t, gate, i < low, spread), True
            if by is not None:
                t, shown = _counted(t), False
        for inner, (lo, hi) in gate.holds.items():
            a, b = holds.get(inner, (0, 0))
            holds[inner] = (a + low * lo, b + high * hi)
    if factors:
        t, shown = _multiplied(t, factors), False
    if ready is not None:
        t, shown = t.select("out", "m").unionAll(ready), False
    if not shown:
        t = t.withColumn("m", F.sort_array("m"))
    if by is not None:
        terms = t.select("out", "m", F.col("n").alias("c"))
    elif flat:
        terms = t.select("out", "m", F.lit(1).cast("long").alias("c"), *(["text"] if text and shown else []))
    else:
        terms = t.groupBy("out", "m").agg(F.count(F.lit(1)).alias("c"))
    if text and "text" not in terms.columns:
        terms = terms.withColumn("text", F.array_join("m", mono.TIMES))
    return Polynomials(terms, delta, flat)


def forms(frame: ProvFrame, kinds: Sequence[str] = ("how",)) -> DataFrame:
    """Result columns with the chosen forms of provenance.

    One row per result row, form and term: the columns, ``form``, ``term``, ``coef``, ``delta``.
    """
    rows = frame.df.select(*frame.columns, mono.monomial_text(PROV).alias("__row"))
    return rows.join(expand(frame).texts(*kinds), F.col("__row") == F.col("out")).drop("__row", "out")


def _counted(t: DataFrame) -> DataFrame:
    """Equal terms of (out, m, n) added up."""
    return t.select("out", F.sort_array("m").alias("m"), "n").groupBy("out", "m").agg(F.sum("n").alias("n"))


def _inline(t: DataFrame, gate, always: bool, spread: bool = False) -> DataFrame:
    """(out, m, text) with one token of the gate replaced in each row; what a pair needs of its row and derivation is made before they meet.

    Numbers of terms, ``n``, stay as they are.
    """
    own = ["out", *(["n"] if "n" in t.columns else [])]
    rows = t.select(*own, "m").withColumn("__t", mono.gate_ref(gate.name, "m"))
    inner = gate.derivations.select(F.col("gate").alias("__g"), F.sort_array(PROV).alias("__m"), mono.monomial_text(PROV).alias("__text"))
    position = F.array_position("m", F.col("__t")).cast("int") - 1
    rest = F.filter("m", lambda x, i: i != F.col("__p"))
    having = rows.filter(F.col("__t").isNotNull()).withColumn("__p", position).select(*own, "__t", rest.alias("__rest"))
    having = _spread(having, inner) if spread else having.join(inner, F.col("__t") == F.col("__g"))
    alone, product = F.size("__rest") == 0, F.sort_array(F.concat("__rest", "__m"))
    m, text = (F.when(alone, F.col(one)).otherwise(made) for one, made in (("__m", product), ("__text", F.array_join(product, mono.TIMES))))
    done = having.select(*own, m.alias("m"), text.alias("text"))
    if always:
        return done
    kept = rows.filter(F.col("__t").isNull()).select(*own, F.sort_array("m").alias("m"), mono.monomial_text("m").alias("text"))
    return done.unionAll(kept)


def _multiplied(t: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """Every row times the sums of all ``gates`` that it holds a token of, one at most of each; their derivations differ and hold no gates.

    A row meets blocks of about ``PACKED`` derivations.  Rows take the blocks of all gates but the last with them, and are dealt once to
    those of the last, where the terms are made and not shuffled again.  Each of its blocks is given as many copies as it takes that
    one meets about ``MEETING`` rows, and the number of partitions is given.
    """
    last = len(gates) - 1
    refs = [F.col(f"__t{i}") for i in range(len(gates))]
    rows = t.withColumns({f"__t{i}": mono.gate_ref(g.name, "m") for i, g in enumerate(gates)})
    bare = reduce(lambda x, y: x & y, [ref.isNull() for ref in refs])
    rest = F.filter("m", lambda x: reduce(lambda y, z: y & z, [~x.eqNullSafe(ref) for ref in refs]))
    having = rows.filter(~bare).withColumn("__rest", rest).drop("m")

    counts = [_block_counts(g) for g in gates]
    meeting, many = having.select(*[f"__t{i}" for i in range(len(gates))]).filter(refs[last].isNotNull()), F.lit(1).cast("long")
    for i in range(last):
        meeting = meeting.join(counts[i].toDF(f"__r{i}", f"__n{i}"), refs[i] == F.col(f"__r{i}"), "left")
        many = many * F.coalesce(f"__n{i}", F.lit(1).cast("long"))
    copies = F.ceil(F.sum(many) / MEETING).cast("int").alias("__s")
    sides = meeting.groupBy(f"__t{last}").agg(copies).join(counts[last], F.col(f"__t{last}") == F.col("__rk")).select("__rk", F.col("__n").cast("int"), "__s")
    # a row without a token of the last gate is dealt by its name, which is no token
    having = having.withColumn("__d", F.coalesce(refs[last], F.xxhash64("out").cast("string")))
    having = having.join(sides.select(F.concat("__rk", F.lit("")).alias("__rk"), "__n", "__s"), refs[last] == F.col("__rk"), "left")
    having = having.filter(refs[last].isNull() | F.col("__rk").isNotNull()).drop("__rk", f"__t{last}")
    dealt = [F.lit(0)]
    for i, (gate, ref) in enumerate(zip(gates[:last], refs)):
        having = having.join(_blocks(gate, i), ref == F.col(f"__g{i}"), "left").filter(ref.isNull() | F.col(f"__g{i}").isNotNull())
        dealt += [ref, F.col(f"__k{i}")]
    one = F.lit(1)
    having = having.withColumn("__k", F.explode(F.sequence(F.lit(0), F.coalesce("__n", one) - 1)))
    having = having.withColumn("__c", F.pmod(F.xxhash64(*dealt), F.coalesce("__s", one)).cast("int"))
    blocks = _blocks(gates[last], last).join(sides.select("__rk", "__s"), F.col(f"__g{last}") == F.col("__rk")).drop("__rk")
    blocks = blocks.withColumn("__h", F.explode(F.sequence(F.lit(0), F.col("__s") - 1))).withColumn(f"__k{last}", F.col(f"__k{last}").cast("int"))
    parts = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    having = having.select("out", "__rest", *[f"__b{i}" for i in range(last)], "__d", "__k", "__c", F.col("__n").isNull().alias("__none"))
    having, blocks = having.repartition(parts, "__d", "__k", "__c"), blocks.drop("__s").repartition(parts, f"__g{last}", f"__k{last}", "__h")
    same = (F.col("__d") == F.col(f"__g{last}")) & (F.col("__k") == F.col(f"__k{last}")) & (F.col("__c") == F.col("__h"))
    having = having.join(blocks, same, "left").filter(F.col("__none") | F.col(f"__g{last}").isNotNull())
    for i in range(len(gates)):
        left = [f"__b{j}" for j in range(i + 1, len(gates))]
        terms = F.coalesce(f"__b{i}", F.array(F.array().cast("array<string>")))
        having = having.select("out", "__rest", *[f"__m{j}" for j in range(i)], *left, F.explode(terms).alias(f"__m{i}"))
    product = F.concat("__rest", *[f"__m{i}" for i in range(len(gates))])
    return having.select("out", product.alias("m")).unionAll(rows.filter(bare).select("out", "m"))


def _block_counts(gate: Gate) -> DataFrame:
    """(__rk, __n): how many blocks the derivations of a token make."""
    return gate.derivations.groupBy("gate").agg(F.ceil(F.count(F.lit(1)) / PACKED).alias("__n")).withColumnRenamed("gate", "__rk")


def _blocks(gate: Gate, i: int) -> DataFrame:
    """(__g, __k, __b) numbered ``i``: the derivations of a token, dealt to blocks by their hash."""
    inner = gate.derivations.select("gate", F.col(PROV).alias("__m"))
    counts = _block_counts(gate)
    block = F.pmod(F.xxhash64("__m"), F.col("__n")).alias(f"__k{i}")
    dealt = inner.join(counts, F.col("gate") == F.col("__rk")).select(F.col("gate").alias(f"__g{i}"), block, "__m")
    return dealt.groupBy(f"__g{i}", f"__k{i}").agg(F.collect_list("__m").alias(f"__b{i}"))


def _spread(rows: DataFrame, inner: DataFrame) -> DataFrame:
    """The join on ``__t = __g``, where few rows may make very many: a token's pairs are cut into a square of blocks.

    Each row is copied to the blocks of its line or column only, and the number of partitions is given: AQE goes by the bytes read.
    """
    one = F.count(F.lit(1))
    pairs = rows.groupBy("__t").agg(one.alias("__a")).join(inner.groupBy("__g").agg(one.alias("__b")), F.col("__t") == F.col("__g"))
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("__a").cast("double") * F.col("__b") / BLOCK))).cast("int")
    sides = pairs.select(F.concat("__t", F.lit("")).alias("__rk"), side.alias("__side"))
    every = F.explode(F.sequence(F.lit(0), F.col("__side") - 1))
    own = lambda *c: F.pmod(F.xxhash64(*c), F.col("__side")).cast("int")
    left = rows.join(sides, F.col("__t") == F.col("__rk")).drop("__rk").withColumn("__i", own("out", "__rest")).withColumn("__j", every)
    right = inner.join(sides, F.col("__g") == F.col("__rk")).drop("__rk").withColumn("__k", own("__m")).withColumn("__h", every)
    # both sides: either may be the one that is not broadcast
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(parts, "__t", "__i", "__j"), right.repartition(parts, "__g", "__h", "__k")
    same = (F.col("__t") == F.col("__g")) & (F.col("__i") == F.col("__h")) & (F.col("__j") == F.col("__k"))
    return left.drop("__side").join(right.drop("__side"), same).drop("__i", "__j", "__h", "__k")
