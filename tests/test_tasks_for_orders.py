"""The lines of orders are dealt to tasks before they are gathered, to more tasks where there are more orders."""

from quire.sources import tables
from quire.structure_queries import REGISTRY


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_gathered_only_where_they_are_dealt(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    few = spark.sparkContext.defaultParallelism
    assert tables.tasks_for_orders(spark, sf) == few
    monkeypatch.setattr(tables, "ORDERS_A_TASK", 100)
    n = tables.tasks_for_orders(spark, sf)
    assert n == max(few, 15)
    monkeypatch.setattr(tables, "ORDERS_A_TASK", 1500 // (few + 3))
    n = tables.tasks_for_orders(spark, sf)
    assert n > few
    plan = _plan(tables.markdown_orders(spark, sf)).splitlines()
    gathers, deals = ([i for i, line in enumerate(plan) if word in line] for word in ("collect_list", "Exchange hashpartitioning(l_orderkey"))
    # A plan's lines go from its result to what it reads.
    assert deals and max(gathers) < min(deals)
    assert str(n) in plan[deals[0]]
    for query in ("section_paths", "grouped_units"):
        assert f", {n}), REPARTITION_BY_NUM" in _plan(REGISTRY[query][0](spark, sf)).split("Window")[-1].split("Exchange")[1]
