"""Tables that grow with the items are joined by sorting: none is gathered on the driver, however small its file is."""

import os

import pytest

from sparkdecide import catalog
from tests import oracle

NAMES = [
    "s8_initial_policy", "l2_value_lookup", "l3_policy_lookup", "l4_demand_cross", "a7_expected_next_value", "c1_compare_policies", "c3_base_stock_report", "t3_method_union",
    "a6_expected_cost", "w8_sliding_best", "a12_sweep_delta", "a13_policy_changes", "c2_value_error", "p5_base_stock_level", "p1_p2_p3_p4_period", "m7_base_stock_backtest", "m10_td_target", "m12_greedy_from_q",
]


@pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_nothing_is_broadcast(spark, name):
    plan = catalog.QUERIES[name](spark, oracle.SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
