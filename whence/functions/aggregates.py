"""Aggregates that know both their value and their tensor.

The value is an ordinary Spark aggregate (partial aggregation, no collecting).
The tensor is one value per derivation; evaluating it again gives the aggregate,
also after some derivations have been removed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from whence.functions.monomials import as_column

# Joining symbol of a tensor sum by kind of aggregate.
TENSOR_PLUS = {"sum": " +sum ", "count": " +count ", "avg": " +avg ", "min": " +min ", "max": " +max "}


@dataclass(frozen=True)
class Agg:
    kind: str
    column: Column | str | None = None
    scale: float | Callable[[Column], Column] | None = None

    def __post_init__(self):
        if self.kind in ("min", "max") and callable(self.scale):
            raise ValueError("min and max take a number as scale: a function may turn their order around")

    @property
    def folds(self) -> str:
        """Kind that folds the scaled tensor: a negative factor turns min and max around."""
        if self.kind in ("min", "max") and self.scale is not None and self.scale < 0:
            return {"min": "max", "max": "min"}[self.kind]
        return self.kind

    def _scaled(self, c: Column) -> Column:
        """Apply a constant factor, or a function such as ``lambda v: v / 7``, to value and tensor alike."""
        if self.scale is None:
            return c
        return self.scale(c) if callable(self.scale) else c * F.lit(self.scale)

    def _input(self) -> Column | None:
        return None if self.column is None else as_column(self.column)

    def value(self) -> Column:
        c = self._input()
        if self.kind == "sum":
            return self._scaled(F.sum(c))
        if self.kind == "count":
            return self._scaled(F.count(F.lit(1) if c is None else c))
        if self.kind == "avg":
            return self._scaled(_mean(c))
        if self.kind == "min":
            return self._scaled(F.min(c))
        if self.kind == "max":
            return self._scaled(F.max(c))
        if self.kind == "distinct":
            return F.count_distinct(c)
        if self.kind == "derivations":
            return F.count(F.lit(1))
        raise ValueError(f"unknown aggregate {self.kind!r}")

    def tensor(self) -> Column | None:
        """Value of one derivation; None if the aggregate has no tensor."""
        if self.kind == "derivations":
            return None
        if self.kind == "count":
            one = F.lit(1).cast("long")
            c = self._input()
            return self._scaled(one if c is None else F.when(c.isNull(), F.lit(0).cast("long")).otherwise(one))
        if self.kind == "distinct":
            return self._input().cast("string")
        return self._scaled(self._input())


def _mean(c: Column) -> Column:
    # exact sum first, one division at the end; NULL inputs do not count
    return F.sum(c).cast("double") / F.count(c)


def evaluate(kind: str, tensor: Column) -> Column:
    """Aggregate expression that folds the tensor column of the derivations."""
    return {
        "sum": lambda: F.sum(tensor),
        "count": lambda: F.coalesce(F.sum(tensor), F.lit(0)),
        "avg": lambda: _mean(tensor),
        "min": lambda: F.min(tensor),
        "max": lambda: F.max(tensor),
        "distinct": lambda: F.count_distinct(tensor),
    }[kind]()


def sum_(column: Column | str, scale=None) -> Agg:
    return Agg("sum", column, scale)


def count(column: Column | str | None = None, scale=None) -> Agg:
    return Agg("count", column, scale)


def avg(column: Column | str, scale=None) -> Agg:
    return Agg("avg", column, scale)


def min_(column: Column | str, scale=None) -> Agg:
    return Agg("min", column, scale)


def max_(column: Column | str, scale=None) -> Agg:
    return Agg("max", column, scale)


def count_distinct(column: Column | str) -> Agg:
    return Agg("distinct", column)


def derivations() -> Agg:
    """Number of derivations of the group (``cntprov``)."""
    return Agg("derivations")
