"""How often plans read their tables and call Python; more would be a step back."""

import os

import pytest

from shroudline import plans

SF = "/root/testdata/sf0.001"
QUERIES, _ = plans.load()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.mark.parametrize("name, scans, exchanges, workers", [
    ("review_apply", 3, 6, 0), ("scrub_documents", 1, 0, 1), ("audit_topk", 1, 0, 1), ("decide", 1, 0, 1), ("session_correlation", 3, 6, 0),
])
def test_plan(spark, name, scans, exchanges, workers):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= scans
    assert plan.count("Exchange hashpartitioning") <= exchanges
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") <= workers
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
