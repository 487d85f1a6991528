"""Column functions on monomials.

A monomial is an ``array<string>`` of tokens; repeats are exponents.  A row of an
annotated DataFrame carries exactly one monomial, a polynomial is a set of rows
that share a gate token.  Everything here is a built-in Spark expression.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reserved column names.
PROV = "prov"
COND = "cond"

# The display symbols of provenance polynomials.
TIMES = " . "
PLUS = " + "
DELTA = "δ"
TENSOR = " ⊗ "
AND = " ∧ "
OR = " ∨ "

COND_TYPE = (
    "array<struct<gate:string,tensor:string,op:string,"
    "rhs:string,rhs_gate:string,rhs_tensor:string>>"
)


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_text(
    keys: Iterable[Column | str], types: Mapping[str, str] | None = None, separator: str = "|"
) -> Column:
    """Text of a compound key; separators inside strings are escaped, NULL is ``\\N``.

    Columns that ``types`` shows not to be strings are not searched for separators; of floats
    -0.0 prints as 0.0, since grouping and ``=`` take them as one.
    """
    parts = []
    for k in keys:
        kind = types.get(k, "string") if types is not None and isinstance(k, str) else "string"
        text = (as_column(k) + F.lit(0.0) if kind in ("double", "float") else as_column(k)).cast("string")
        parts.append(key_part(text, separator, kind == "string"))
    return F.concat_ws(separator, *parts) if parts else F.lit("")


def key_part(text: Column, separator: str, escape: bool = True) -> Column:
    """One part of a compound key."""
    if escape:
        text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(separator), F.lit("\\" + separator))
    return F.coalesce(text, F.lit("\\N"))


def gate_token(name: str, keys: Iterable[Column | str], types: Mapping[str, str] | None = None) -> Column:
    return F.concat(F.lit(f"{name}["), key_text(keys, types), F.lit("]"))


def match_token(name: str, keys: Iterable[Column | str], types: Mapping[str, str] | None = None) -> Column:
    """Gate token that is NULL when a key is NULL, so that it never joins (SQL ``=``)."""
    keys = list(keys)
    present = F.lit(True)
    for k in keys:
        present = present & as_column(k).isNotNull()
    return F.when(present, gate_token(name, keys, types))


def gate_ref(name: str, monomial: Column | str = PROV) -> Column:
    """First token of gate ``name`` in the monomial, NULL if it has none."""
    return F.get(F.filter(as_column(monomial), lambda t: t.startswith(f"{name}[")), F.lit(0))


def monomial_text(monomial: Column | str = PROV) -> Column:
    return F.array_join(F.sort_array(as_column(monomial)), TIMES)


def support(monomial: Column | str = PROV) -> Column:
    return F.sort_array(F.array_distinct(as_column(monomial)))


def term_text(monomial: Column | str, coef: Column | str) -> Column:
    coef = as_column(coef)
    text = monomial_text(monomial)
    return F.when(coef == 1, text).otherwise(F.concat(coef.cast("string"), F.lit("*"), text))


def condition(gate: Column, tensor: str, op: str, rhs: Column) -> Column:
    """Symbolic condition ``gate.tensor op 1⊗rhs``; the value is kept as text, exact for every type."""
    return F.struct(
        gate.alias("gate"),
        F.lit(tensor).alias("tensor"),
        F.lit(op).alias("op"),
        rhs.cast("string").alias("rhs"),
        F.lit(None).cast("string").alias("rhs_gate"),
        F.lit(None).cast("string").alias("rhs_tensor"),
    )


def tensor_condition(gate: Column, tensor: str, op: str, rhs_gate: Column, rhs_tensor: str) -> Column:
    """Symbolic condition between two tensors."""
    return F.struct(
        gate.alias("gate"),
        F.lit(tensor).alias("tensor"),
        F.lit(op).alias("op"),
        F.lit(None).cast("string").alias("rhs"),
        rhs_gate.alias("rhs_gate"),
        F.lit(rhs_tensor).alias("rhs_tensor"),
    )


def condition_text(cond: Column | str = COND) -> Column:
    """`` . [gate.tensor op 1⊗v]`` for every condition of the row."""

    def one(c: Column) -> Column:
        right = F.when(
            c["rhs_gate"].isNull(),
            F.concat(F.lit("1⊗"), F.coalesce(c["rhs"].try_cast("decimal(28,4)").cast("string"), c["rhs"])),
        ).otherwise(F.concat(c["rhs_gate"], F.lit("."), c["rhs_tensor"]))
        return F.concat(
            F.lit(f"{TIMES}["), c["gate"], F.lit("."), c["tensor"], F.lit(" "), c["op"], F.lit(" "), right, F.lit("]")
        )

    return F.array_join(F.transform(as_column(cond), one), "")


_FLIP = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def flip(op: str) -> str:
    """The operator with its sides swapped."""
    if op not in _FLIP:
        raise ValueError(f"comparison must be one of {sorted(_FLIP)}, not {op!r}")
    return _FLIP[op]


def compare(left: Column, op: str, right: Column) -> Column:
    flip(op)
    return {
        "=": lambda: left == right,
        "<>": lambda: left != right,
        "<": lambda: left < right,
        "<=": lambda: left <= right,
        ">": lambda: left > right,
        ">=": lambda: left >= right,
    }[op]()
