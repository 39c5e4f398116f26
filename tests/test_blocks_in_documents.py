"""Blocks are found inside the row of their document."""

from quire import structure_queries
from quire.operators import blocks, structure

SF = "/root/testdata/sf0.001"


def test_blocks_need_no_sort_or_window_of_lines(spark):
    for name in ("table_blocks", "classify_lines", "document_title", "table_cells", "numbered_headings"):
        plan = structure_queries.REGISTRY[name][0](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and plan.count("Aggregate") == 1, name


def test_a_control_character_in_text_stays(spark):
    docs = spark.createDataFrame([(1, "```\na\x02b\n```\n- one\x02two\n\n- three\n  more\n\ntext\x02end")], "doc_id long, text string")
    found = blocks.blocks(structure.explode_lines(docs)).orderBy("block_no").collect()
    assert [r.text for r in found] == ["a\x02b", "one\x02two\nthree\nmore", "text\x02end"]


def test_neighbours_are_those_of_the_same_document(spark):
    docs = spark.createDataFrame([(1, "intro:"), (2, "2 Title"), (3, "1. a"), (4, "2. b"), (5, "| a |"), (6, "|---|---|"), (7, "- x"), (8, "\n  y\n- z"), (9, "> q"), (10, "> r")], "doc_id long, text string")
    found = {r.doc_id: (r.type, r.text) for r in blocks.blocks(structure.explode_lines(docs.coalesce(1))).orderBy("doc_id", "block_no").where("block_no = 0").collect()}
    assert found == {1: ("paragraph", "intro:"), 2: ("title", "2 Title"), 3: ("title", "1 a"), 4: ("title", "2 b"), 5: ("paragraph", "| a |"), 6: ("paragraph", "|---|---|"), 7: ("list", "x"), 8: ("paragraph", "y"), 9: ("quote", "q"), 10: ("quote", "r")}
