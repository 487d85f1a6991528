"""Provenance-annotated DataFrame operators for Spark."""

from whence.operators.frame import Gate, ProvFrame, join_all
from whence.operators.grouping import distinct, group, having, union
from whence.operators.semirings import Polynomials, expand
from whence.sources.tokens import annotate_keys, annotate_ordinal, read_annotated

__all__ = [
    "Gate",
    "Polynomials",
    "ProvFrame",
    "annotate_keys",
    "annotate_ordinal",
    "distinct",
    "expand",
    "group",
    "having",
    "join_all",
    "read_annotated",
    "union",
]
