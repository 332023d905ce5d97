"""Plan guards over every registered query."""

import re

import __spark_entry__ as entry

# cross joins, and row-at-a-time Python UDFs (only Arrow-batched ones are allowed)
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def test_no_cross_joins_or_row_udfs_in_any_plan(spark, sf):
    bad = {}
    for name, fn in sorted(entry.queries().items()):
        if re.fullmatch(r"op\d+_.*|pipeline", name):  # those run jobs of their own and have their own tests
            continue
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        hits = [f for f in FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert bad == {}
