"""Plan guards: no nested-loop or cartesian joins, no row-at-a-time Python
UDFs, in any query that has a SQL twin (the relational part of the engine)."""

from rulesift.plans import catalog

from conftest import SF001

catalog.load_all()

FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython")


def test_no_nested_loop_cartesian_or_row_udf(spark):
    bad = {}
    for name in sorted(catalog.ORACLE):
        plan = catalog.QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        hits = [k for k in FORBIDDEN if k in plan]
        if hits:
            bad[name] = hits
    assert not bad, bad
