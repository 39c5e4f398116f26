"""Blocks, responses and files on hostile values."""

from pyspark.sql import functions as F

from quire.operators import blocks, metadata, objects, responses, structure
from quire.sources import files

TEXT = """# Title one

intro line:
1. foo
2. bar
   cont

1. lone
text here
| a | b |
|---|---|
| 1 |  2 |
|--|--|
~~~py
x = 1
```
~~~~
> q1
>q2
***
2.3 Numbered
#### Deep
para
## Next
| Version | **v2.1** |
version: abc"""


def test_blocks_of_hostile_lines(spark):
    rows = [(1, TEXT), (2, "　\n\t"), (3, "plain\r\ntwo"), (4, "```\nnever closed\n\n# x"), (5, None), (6, "")]
    lines = structure.explode_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    found = blocks.section_paths(blocks.blocks(lines)).orderBy("doc_id", "block_no").collect()
    assert [(r.doc_id, r.type, r.text, r.line_start, r.line_end) for r in found] == [
        (1, "title", "Title one", 1, 1), (1, "paragraph", "intro line:", 3, 3), (1, "list", "foo\nbar\ncont\nlone", 4, 8), (1, "paragraph", "text here", 9, 9),
        (1, "table", "| a | b |\n| 1 | 2 |\n| -- | -- |", 10, 13), (1, "code", "x = 1\n```", 14, 17), (1, "quote", "q1\nq2", 18, 19), (1, "section_break", "---", 20, 20),
        (1, "title", "2.3 Numbered", 21, 21), (1, "title", "Deep", 22, 22), (1, "paragraph", "para", 23, 23), (1, "title", "Next", 24, 24), (1, "paragraph", "| Version | **v2.1** |\nversion: abc", 25, 26),
        (3, "paragraph", "plain\ntwo", 1, 2), (4, "code", "never closed\n\n# x", 1, 4)]
    assert [r.section_path for r in found if r.text in ("para", "version: abc", "Next")] == [["Title one", "2.3 Numbered", "Deep"], ["Title one", "Next"]]
    assert next(r.ordered for r in found if r.type == "list") and next(r.language for r in found if r.type == "code") == "py"


def test_versions(spark):
    given = {"| 文档版本 | v1.0 |": "v1.0", "文档版本：1.2.3": "1.2.3", "API v1 is here": None, "TLS 1.3 works": None, "version: abc": None, "**Version**: 2": None, "| a | Document Version | `1.2-rc.1`; |": "1.2-rc.1", "": None}
    rows = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    found = {r.doc_id: r.version for r in metadata.extract_version(rows).collect()}
    assert [found.get(i) for i in range(len(given))] == list(given.values())


def test_json_is_repaired_or_refused(spark):
    given = {'{"a": [1, {"b": "x"': ("repaired", '{"a": [1, {"b": "x"}]}'), '{"a": 1, "b": "cut': ("repaired", '{"a": 1}'), "{'a': 'it'}": ("repaired", '{"a": "it"}'), "```json\n{}\n```": ("parsed", "{}"), "no": ("failed", None), "": ("failed", None), "[1, 2": ("repaired", "[1, 2]")}
    rows = spark.createDataFrame([*enumerate(given), (99, None)], "i long, response string")
    found = {r.i: (r.outcome, r.parsed) for r in responses.parse_json(rows).collect()}
    assert [found[i] for i in range(len(given))] == list(given.values()) and found[99] == ("failed", None)


def test_failing_calls_are_rows(spark):
    rows = spark.createDataFrame([(1, "2"), (2, "x"), (3, "0")], "doc_id long, request string")
    out = {r.doc_id: (r.response, r.error) for r in responses.batch_infer(rows, lambda t: str(1 // int(t)), 2).collect()}
    assert out[1] == ("0", None) and out[2][1].startswith("ValueError") and out[3][1].startswith("ZeroDivisionError")


def test_empty_lists_unite(spark):
    rows = spark.createDataFrame([(1, 1, ["b", "a"]), (1, 2, ["a", "c", "b"]), (2, 1, [])], "doc_id long, seq long, v array<string>")
    assert [(r.doc_id, r.v) for r in objects.union_lists(rows, "v").collect()] == [(1, ["b", "a", "c"])]


def test_text_files_and_typed_json(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("标题\n".encode())
    (tmp_path / "b.TXT").write_bytes(b"plain")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    found = {r.path[-5:].lower(): r.content for r in files.scan_text_corpus(spark, str(tmp_path)).collect()}
    assert found == {"/a.md": "标题\n", "b.txt": "plain"}
    routed = files.route_by_extension(spark.createDataFrame([("x/y.Docx",), ("z.exe",), ("none",)], "path string")).select("source_type", F.col("message").isNull().alias("ok")).collect()
    assert [tuple(r) for r in routed] == [("docx", True), (None, False), (None, False)]
