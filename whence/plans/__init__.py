"""Workload queries on the given tables, each with equivalent SQL."""

from whence.plans.base import REGISTRY, Query


def registry() -> dict[str, Query]:
    from whence.plans import features, spatial, ssb, ssbplus, tpch  # noqa: F401

    return REGISTRY
