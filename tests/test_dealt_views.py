"""Pairs of neighbouring words are found and grouped where their line was dealt: words and pairs don't travel."""

import pytest

from reelmill.plans import registry


@pytest.mark.parametrize("name", ["c8_first_pair", "c9_best_pair", "e6_left_right_pairs"])
def test_only_lines_travel(spark, small, name):
    plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Window") < plan.index("Generate") < plan.index("Exchange hashpartitioning")
