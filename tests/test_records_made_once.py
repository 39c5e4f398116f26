"""Cleaned values are made once, and merged records stay what they are at any depth of ranges."""

import pytest
from pyspark.sql import functions as F

from quire import merging_queries
from quire.operators import merging


def test_cleaning_names_each_value_a_few_times(spark):
    plan = merging_queries._candidates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 60


def test_a_deep_record_is_cleaned_in_a_small_plan(spark):
    frame = spark.createDataFrame([((((((" x ", " "),),),),),)], "item struct<a struct<b struct<c struct<d struct<e string, f string>>>>>")
    found = merging.cleaned_records(frame)
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_replace") <= 8
    leaf = found.first()["item"]["a"]["b"]["c"]["d"]
    assert (leaf["e"], leaf["f"]) == ("x", None)


@pytest.mark.parametrize("width", [1, 2, 1000])
def test_single_and_many_records_merge_alike(spark, width):
    rows = [("one", 5, ("", ["a", "a"], None, (" ",))), ("many", 3, ("ab ", None, 2, None)), ("many", 1, ("", [], None, ("x",))), ("many", 2, ("cd", ["b"], 1, None)), ("many", 4, (" ef", ["b", "c"], None, ("longer",)))]
    frame = spark.createDataFrame(rows, "k string, seq long, item struct<s string, l array<string>, n int, r struct<t string>>")
    got = {r.k: (r.first_seq, r.item.s, r.item.l, r.item.n, r.item.r.t, r.candidates) for r in merging.merge_records(frame, ("k",), width=width).collect()}
    assert got == {"one": (5, None, ["a", "a"], None, " ", 1), "many": (1, "cd", ["b", "c"], 1, "longer", 4)}
