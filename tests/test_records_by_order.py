"""Records are made, keyed and merged where the lines of their order are dealt; only plain columns of lines are shuffled."""

import re

import duckdb
import pytest

from quire import merging_queries
from quire.sources import tables
from test_queries import SF, rows


@pytest.fixture(params=["-1", "10m"], ids=["parts_dealt", "parts_sent"])
def joins(spark, request):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("query,again", [("merge_records", ["l_orderkey"]), ("record_identity", [])])
def test_no_record_is_shuffled(spark, joins, query, again):
    plan = merging_queries.REGISTRY[query][0](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#\w+, \d+\)", plan)
    assert plan.count("Exchange hashpartitioning") == len(dealt)
    assert dealt == ([*again, "l_partkey", "l_orderkey", "p_partkey"] if joins == "-1" else ["l_orderkey"])


def test_more_lines_are_dealt_to_more_tasks(spark, monkeypatch):
    few = spark.sparkContext.defaultParallelism
    assert tables.tasks_for_lines(spark, str(SF)) == few
    n = tables.table(spark, str(SF), "lineitem").count()
    monkeypatch.setattr(tables, "LINES_A_TASK", n // (few + 3))
    more = tables.tasks_for_lines(spark, str(SF))
    assert more > few
    plan = merging_queries.REGISTRY["merge_records"][0](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert f", {more}), REPARTITION_BY_NUM" in plan


def test_odd_lines_match_sql(spark, joins, tmp_path):
    """Lines without a part keep their number; one order has a third of all lines; keys are missing."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{SF}/part.parquet' WHERE p_partkey % 3 <> 1) TO '{tmp_path}/part.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 3 WHEN l_orderkey % 50 = 1 THEN NULL ELSE l_orderkey END AS l_orderkey, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_partkey END AS l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)::INT AS l_linenumber) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    for name in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    for query in ("record_identity", "merge_records"):
        run, sql = merging_queries.REGISTRY[query]
        got = rows(run(spark, str(tmp_path)).where("doc_id is not null").toPandas())
        assert got == rows(con.execute(f"SELECT * FROM ({sql}) WHERE doc_id IS NOT NULL").df())
