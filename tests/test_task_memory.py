"""What a task holds doesn't grow with the number of items."""

import re

import pyarrow as pa

from sparkdecide.operators import inventory as V
from sparkdecide.plans import batches


def test_a_large_record_batch_is_solved_in_parts():
    row = {"item": 1, "x_min": -2, "x_max": 8, "demand": [{"d": d, "p": 0.2} for d in range(5)]}
    batch = pa.RecordBatch.from_pylist([row | {"item": k} for k in range(10_000)])
    parts = list(batches._chunks(batch, 10))
    assert [r["item"] for rows in parts for r in rows] == list(range(10_000))
    assert max(map(len, parts)) <= 1024


def test_levels_are_dealt_out_before_they_are_made_distinct(spark):
    actions = spark.createDataFrame([(1, 0), (1, 0), (1, 2)], "item long, y int")
    pmf = spark.createDataFrame([(1, 1, 1.0)], "item long, d int, p double")
    params = spark.createDataFrame([(1, 1.0, 9.0, -2, 8)], "item long, h double, b double, x_min int, x_max int")
    for out, want in ((V.expected_cost(actions, pmf, params), [(1, 0, 9.0), (1, 2, 1.0)]), (V.transitions(actions, pmf, params), [(1, 0, -1, 1.0), (1, 2, 1, 1.0)])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"Aggregate \[item#\d+L?, (_at|y)#\d+\][^\n]*\n[^\n]*RepartitionByExpression", plan)
        assert sorted(tuple(r) for r in out.collect()) == want
