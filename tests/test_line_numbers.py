"""What a line is on its own is found by Arrow for all lines of a batch; no expression of Spark goes from line to line."""

from quire.operators import blocks, structure


def test_spans_need_no_line_pattern_of_spark(spark):
    docs = spark.createDataFrame([(1, "# a\n- b")], "doc_id long, text string")
    plan = blocks._spans(structure.gathered_lines(docs).select("doc_id", "lines"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_labels_of_odd_lines(spark):
    odd = {"　# a": "heading", "#a": "text", "# b": "heading", "# a b": "text", "####### a": "text", "٣. a": "heading", "٣ a": "heading", "𝟏 a": "heading", "1.2 x" + "x" * 120: "text", "1.2 " + "x" * 120: "heading", "1.2 ends。": "text", "-- -": "text", "- a": "item", "---": "break", "`` a": "text", "~~~": "fence", ">": "quote", "\x85": "blank", "\x1c": "text", "\x00": "text", "9999999999 a": "heading", "|": "text"}
    rows = [(k, [1], [line]) for k, line in enumerate(odd)] + [(-1, [1], [None]), (-2, [], [])]
    found = {r.doc_id: r.labels for r in blocks.labelled(spark.createDataFrame(rows, "doc_id long, line_nos array<long>, lines array<string>")).collect()}
    assert {line: found[k][0] for k, line in enumerate(odd)} == odd
    assert found[-1] == ["text"] and found[-2] == []


def test_bytes_that_are_no_utf8(spark):
    rows = spark.range(1).selectExpr("id as doc_id", "array(1L, 2L) as line_nos", "array('# a', cast(X'2D20FF' as string)) as lines")
    assert blocks.labelled(rows).first().labels == ["heading", "item"]


def test_a_title_is_stripped_once_for_its_path(spark):
    rows = spark.createDataFrame([(1, 0, "title", 1, "　a "), (1, 1, "title", 2, " b"), (1, 2, "title", 1, " 　"), (1, 3, "quote", None, "c"), (1, 4, "title", None, None)], "doc_id long, block_no int, type string, level int, text string")
    found = blocks.section_paths(rows)
    assert [r.section_path for r in found.orderBy("block_no").collect()] == [["a"], ["a", "b"], ["a", "b"], ["a", "b"], ["a", "b"]]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2
