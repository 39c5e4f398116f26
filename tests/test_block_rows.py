"""What a block says is found in its own row; a title needs no other block's text."""

from quire import structure_queries
from quire.operators import blocks, structure


def test_a_title_needs_no_text_of_tables_and_lists(spark):
    plan = structure_queries.REGISTRY["document_title"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join") <= 4


def test_titles_of_odd_documents(spark):
    docs = spark.createDataFrame([(1, "## b\n# first \n# second"), (2, "short\n"), (3, "two\nlines"), (4, "- a\n- b"), (5, "x" * 121), (6, " \n　"), (7, None), (8, "　\rpara\r\r## t"), (9, "## only")], "doc_id long, text string")
    got = {r.doc_id: r.title for r in blocks.document_title(structure.gathered_lines(docs)).collect()}
    assert got == {1: "first", 2: "short", 3: None, 4: None, 5: None, 8: "para", 9: None}


def test_cells_and_quotes_lose_all_white_space_at_their_ends(spark):
    docs = spark.createDataFrame([(1, "| 　a b\t|c |\n|---|---|\n||  |d|\n\n> q 　\n> r")], "doc_id long, text string")
    found = {r.type: r.text for r in blocks.blocks(structure.explode_lines(docs)).collect()}
    assert found == {"table": "| a b | c |\n|  | d |", "quote": "q\nr"}
