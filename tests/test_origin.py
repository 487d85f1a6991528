"""Knowing that monomials cannot repeat only saves work: results stay the same."""

from dataclasses import replace

import pytest

from whence import expand
from whence.operators.frame import Origin
from whence.plans import features, ssb, tpch
from whence.plans.base import Tables
from test_queries import SF_DIR

FRAMES = {
    "q2": tpch.q2, "q4": tpch.q4, "q7": tpch.q7, "q9": tpch.q9, "q13": tpch.q13, "q15": tpch.q15, "q18": tpch.q18,
    "q20": tpch.q20, "q21": tpch.q21, "q22": tpch.q22,
    "ssb": lambda t: ssb.star(t, "dps", "p_type = 'PROMO'"),
    "mix": features.rich_mix, "self": features.same_line, "sums": features.sums_of_sums, "heavy": features.heavy_orders,
    "returns": features.with_returns, "any": features.any_local,
    "best": lambda t: features.best_orders(t, "resolved"),
    "counts": features.two_counts,
}


def careful(frame):
    """The same frame with nothing known about its tokens."""
    gates = tuple(replace(g, origin=Origin()) for g in frame.gates)
    return replace(frame, gates=gates, origin=Origin(), whole=None)


@pytest.mark.parametrize("name", FRAMES)
def test_shortcuts_do_not_change_results(spark, name):
    f = FRAMES[name](Tables(spark, SF_DIR))
    terms = lambda g: sorted((r["out"], tuple(r["m"]), r["c"]) for r in expand(g).terms.collect())
    assert terms(f) == terms(careful(f))
    for form in ("trio", "why"):
        read = lambda g: sorted(str(r) for r in getattr(expand(g), form)().collect())
        assert read(f) == read(careful(f))
    if f.gates:
        rows = lambda g: sorted(map(tuple, g.circuit().collect()))
        assert rows(f) == rows(careful(f))


def test_plain_joins_of_different_tables_are_flat(spark):
    t = Tables(spark, SF_DIR)
    assert tpch.q5(t).gate("Q5").origin.flat
    assert not tpch.q7(t).gate("Q7").origin.flat  # nation twice
    assert not features.rich_mix(t).gate("MIX").origin.unique
    plan = expand(tpch.q1(t)).terms._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
