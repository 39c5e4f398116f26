"""classify_lines returns every line with its label, not what the lines of a document add up to."""

from pyspark.sql import functions as F

from quire import structure_queries
from quire.operators import blocks, structure
from quire.sources.tables import markdown_orders
from test_queries import SF


def test_each_line_of_each_document_has_a_row(spark):
    found = structure_queries.REGISTRY["classify_lines"][0](spark, str(SF))
    lines = structure.explode_lines(markdown_orders(spark, str(SF)))
    assert found.count() == lines.count()
    body = blocks.stripped(F.col("line")).alias("body")
    assert found.select("doc_id", "line_no", "body").exceptAll(lines.select("doc_id", "line_no", body)).count() == 0


def test_lines_keep_their_numbers_labels_and_titles(spark):
    texts = ["# a ", "", "1.2 b", "## c\r\n- d\r> e", None, " \n", "```\n# f\n```", "| g |\n|---|---|\n| h |", "___", "i:\n2 j"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [
        (0, 1, "# a ", "# a", "heading", 1, "a"), (2, 1, "1.2 b", "1.2 b", "heading", 2, "1.2 b"), (3, 1, "## c", "## c", "heading", 2, "c"), (3, 2, "- d", "- d", "item", None, None), (3, 3, "> e", "> e", "quote", None, None),
        (6, 1, "```", "```", "fence", None, None), (6, 2, "# f", "# f", "heading", 1, "f"), (6, 3, "```", "```", "fence", None, None), (7, 1, "| g |", "| g |", "table", None, None), (7, 2, "|---|---|", "|---|---|", "text", None, None), (7, 3, "| h |", "| h |", "text", None, None),
        (8, 1, "___", "___", "break", None, None), (9, 1, "i:", "i:", "text", None, None), (9, 2, "2 j", "2 j", "text", None, None),
    ]
    assert [tuple(r) for r in blocks.classified(structure.gathered_lines(docs)).orderBy("doc_id", "line_no").collect()] == want
    assert [tuple(r) for r in blocks.classify_lines(structure.explode_lines(docs)).orderBy("doc_id", "line_no").collect()] == want
