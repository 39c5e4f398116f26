"""Layout elements and rendering on hostile values, against plain walks."""

from __future__ import annotations

import math
import random
import re
from datetime import timedelta

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import blocks, layout, render, structure


def plain_merge(rows):
    """One document's (ord, label, text, page), in order, element by element."""
    out = []
    for number, label, text, page in rows:
        kind = layout.BLOCK_TYPES.get((label or "").strip().lower(), "paragraph")
        own = (text or "").strip()
        if out and kind == "paragraph" and out[-1]["kind"] == "paragraph":
            run = out[-1]
            before = (run["text"] or "").strip()
            structural = re.match(r"#{1,6}\s+\S|\|.*\|$|([-+*]|\d+\.)\s+\S", own)
            page_fits = run["page"] is None or page is None or run["page"] == page
            colon = before.endswith((":", "：")) or own.startswith((":", "："))
            if before and own and page_fits and not (len(own) > 15 and structural) and (colon or (not before.endswith(layout.SENTENCE_ENDS) and len(before) >= 5)):
                blank = "" if own.startswith(layout.CLOSERS) or (ord(before[-1]) > 127 and ord(own[0]) > 127) else " "
                run["text"], run["merged"] = run["text"].rstrip() + blank + own, run["merged"] + 1
                continue
        out.append({"ord": number, "kind": kind, "label": label, "text": text, "page": page, "merged": 1})
    return [(r["ord"], r["label"], r["text"], r["page"], r["merged"]) for r in out]


TEXTS = ["ab", "a", ":", "：中", "中文字", "中文。", "done.", "goes on", " spaced　", "", None, "- an item", "- an item of more than fifteen", "# a title of more than fifteen", "# t", "|a|", "| a row of more than fifteen |", "x:", "（", "）end", "1. x", "3"]


@pytest.mark.parametrize("size", [3, 4096])
def test_paragraphs_merge_as_one_by_one(spark, size):
    rng = random.Random(size)
    rows = []
    for doc in [None, *range(60)]:
        n = rng.choice([1, 2, 7, 40])
        rows += [(doc, k, rng.choice(["text", "text", "paragraph", "Text ", "section_header", None, "odd"]), rng.choice(TEXTS), rng.choice([None, 1, 1, 2])) for k in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, ord long, label string, text string, page int").withColumn("first", F.lit("clash"))
    got = sorted((tuple(r) for r in layout.merge_adjacent_paragraphs(frame, size).collect()), key=repr)
    want = sorted(((doc, *r) for doc in {r[0] for r in rows} for r in plain_merge([r[1:] for r in rows if r[0] == doc])), key=repr)
    assert got == want


def test_one_document_of_one_long_run(spark):
    frame = spark.range(20_000).select(F.lit("d").alias("doc_id"), F.col("id").alias("ord"), F.lit("text").alias("label"), F.format_string("goes on %d", "id").alias("text"), F.lit(None).cast("int").alias("page"))
    row = layout.merge_adjacent_paragraphs(frame, 512).collect()
    assert len(row) == 1 and row[0]["merged"] == 20_000 and row[0]["text"] == " ".join(f"goes on {k}" for k in range(20_000))


def test_no_elements(spark):
    assert layout.merge_adjacent_paragraphs(spark.createDataFrame([], "doc_id long, ord long, label string, text string, page int")).collect() == []


def test_levels_of_a_deep_tree_and_of_circles(spark):
    chain = [("d", k, k - 1 if k else None) for k in range(300)]
    rows = chain + [("e", 1, 2), ("e", 2, 1), ("e", 3, 2), ("e", 4, 77), (None, 1, None), ("f", 5, 5)]
    got = {(r["doc_id"], r["node_id"]): r["level"] for r in layout.traversal_levels(spark.createDataFrame(rows, "doc_id string, node_id long, parent_id long")).collect()}
    assert all(got["d", k] == k + 1 for k in range(300))
    assert (got["e", 1], got["e", 2], got["e", 3], got["e", 4], got[None, 1], got["f", 5]) == (None, None, None, 1, 1, None)


@pytest.mark.parametrize("text,markdown,own,traversal,level", [("1. 系统概述", "1. 系统概述", None, 2, 2), ("1.2.3.4.5.6.7 x", "", None, None, 6), ("Title", "### Title", "5", 1, 3), ("Title", "Title", " 9 ", 1, 6), ("Title", "####### no", "deep", 4, 4), (None, None, None, None, 1), ("2024 plan", "", "0", None, 2), ("Title", None, "-3", 5, 1)])
def test_heading_levels(spark, text, markdown, own, traversal, level):
    frame = spark.createDataFrame([(text, markdown, own, traversal)], "t string, m string, o string, v int")
    assert frame.select(layout.heading_level(*map(F.col, "tmov"))).first()[0] == level


def test_boxes(spark):
    frame = spark.createDataFrame([("1", 2.0, 3, "4"), (None, None, None, None), ("NaN", 1.0, 1, "1"), ("1", math.inf, 1, "1"), ("x", 1.0, 1, "1")], "l string, t double, r int, b string")
    assert [r[0] for r in frame.select(layout.bbox(*map(F.col, "ltrb"))).collect()] == [[1, 4, 3, 2], [0, 0, 0, 0], None, None, None]
    boxes = spark.createDataFrame([(["1", "2", "3", "4"],), (["1", "2", "3"],), (["1", None, "3", "4"],), (["1", "2", "3", "Infinity"],), (None,), ([],)], "b array<string>")
    assert [r[0] for r in boxes.select(layout.valid_box(F.col("b"))).collect()] == [[1, 2, 3, 4], None, None, None, None, None]


def test_boxes_of_one_place(spark):
    rows = [("d", "A", 1, [0.4, 0.0, 10.0, 5.0]), ("d", "B", 1, [10.2, 5.4, -0.3, 0.0]), ("d", "C", 1, [0.5, 0.0, 10.0, 5.0]), ("d", "D", 0, [0.0, 0.0, 9.0, 9.0]), ("d", "E", None, [0.0, 0.0, 9.0, 9.0]), ("d", "F", 1, [1.0, 1.0, 1.0, 9.0]), ("d", "G", 1, None), ("d", "A", 1, [0.4, 0.0, 10.0, 5.0])]
    got = layout.targets_by_box(spark.createDataFrame(rows, "doc_id string, object_id string, page int, bbox array<double>")).collect()
    assert sorted(map(tuple, got)) == [("d", 1, 0, 0, 10, 5, ["A"]), ("d", 1, 0, 0, 11, 5, ["B"]), ("d", 1, 1, 0, 10, 5, ["C"])]


BLOCK = "doc_id long, block_no int, type string, text string, level int, language string, items array<string>, ordered boolean, rows array<array<string>>, raw_markdown string, prefer_html boolean, alt string, src string, fence string"


def rendered(spark, **values):
    names = [c.split()[0] for c in BLOCK.split(", ")]
    row = {"doc_id": 1, "block_no": 0} | values
    return render.render_blocks(spark.createDataFrame([tuple(row.get(n) for n in names)], BLOCK)).first()["markdown"]


@pytest.mark.parametrize("block,markdown", [
    ({"type": "title", "text": " T ", "level": 9}, "###### T"), ({"type": "title", "text": "T"}, "# T"), ({"type": "title", "text": "T", "level": 0}, "# T"), ({"type": "title", "text": "T", "level": -2}, "# T"), ({"type": "quote", "text": "a \n\n b\r\nc"}, "> a\n>  b\n> c"), ({"type": "section_break", "text": None}, "---"),
    ({"type": "code", "text": "x\n\n", "language": "py", "fence": "~~~~"}, "~~~~py\nx\n~~~~"), ({"type": "code", "text": None}, "```\n\n```"), ({"type": "list", "text": " raw "}, "raw"), ({"type": "list", "items": ["a", " ", None, "b\n c \nd"], "ordered": True}, "1. a\n4. b\n   c\n  d"),
    ({"type": "table", "text": "none"}, "none"), ({"type": "table", "rows": [["a", None]]}, "| a |  |\n| --- | --- |\n|  |  |"), ({"type": "table", "rows": [["a"], ["b", "c"]]}, "<table>\n  <tr>\n    <th>a</th>\n  </tr>\n  <tr>\n    <td>b</td>\n    <td>c</td>\n  </tr>\n</table>"),
    ({"type": "table", "rows": [["a"], ["x\ny & <z>|'\""]]}, "<table>\n  <tr>\n    <th>a</th>\n  </tr>\n  <tr>\n    <td>x<br>y &amp; &lt;z&gt;|&#x27;&quot;</td>\n  </tr>\n</table>"), ({"type": "table", "rows": [["a"]], "prefer_html": True}, "<table>\n  <tr>\n    <th>a</th>\n  </tr>\n</table>"),
    ({"type": "table", "rows": [["a"]], "raw_markdown": "| h |\n|---|---|\n"}, "| h |\n|---|---|"), ({"type": "table", "rows": [["a"]], "raw_markdown": "| h |"}, "| a |\n| --- |\n|  |"), ({"type": "image", "text": "t", "src": " s ", "alt": None}, "![](s)"), ({"type": "image", "text": " t ", "src": " "}, "t"), ({"type": "odd", "text": None}, ""),
])
def test_rendering(spark, block, markdown):
    assert rendered(spark, **block) == markdown


def test_rendering_without_attributes(spark):
    frame = spark.createDataFrame([(1, 2, "list", "b"), (1, 1, "title", "a"), (1, 3, "paragraph", None), (2, 1, "paragraph", "")], "doc_id long, block_no int, type string, text string")
    assert {r["doc_id"]: r["markdown"] for r in render.render_blocks(frame).collect()} == {1: "# a\n\nb", 2: ""}


WORDS = st.text("abc中 xyz", min_size=1, max_size=12).map(lambda s: " ".join(s.split())).filter(lambda s: s and not s.isdigit())
SOME = st.one_of(
    st.tuples(st.just("title"), WORDS, st.integers(1, 6)), st.tuples(st.just("paragraph"), st.lists(WORDS, min_size=1, max_size=3).map("\n".join), st.none()), st.tuples(st.just("quote"), st.lists(WORDS, min_size=1, max_size=3).map("\n".join), st.none()),
    st.tuples(st.just("code"), st.lists(WORDS, min_size=1, max_size=3).map("\n".join), st.none()), st.tuples(st.just("list"), st.lists(WORDS, min_size=1, max_size=4), st.booleans()), st.tuples(st.just("table"), st.lists(st.tuples(WORDS, WORDS), min_size=2, max_size=4), st.none()), st.tuples(st.just("section_break"), st.just("---"), st.none()),
)


@settings(max_examples=5, deadline=timedelta(minutes=2), phases=[Phase.generate])
@given(st.lists(st.lists(SOME, min_size=1, max_size=8), min_size=20, max_size=40))
def test_blocks_survive_rendering_and_parsing(spark, documents):
    names, rows, want = [c.split()[0] for c in BLOCK.split(", ")], [], []
    for d, found in enumerate(documents):
        last = None
        number = 0
        for kind, value, more in found:
            if kind == last == "list" or (kind == "title" and not value):
                continue  # two lists in a row are one
            if kind == "list" and more and len(value) == 1:
                more = False  # a numbered list of one item reads as a numbered title
            row = {"doc_id": d, "block_no": number, "type": kind}
            if kind == "list":
                row |= {"items": value, "ordered": more}
                text = "\n".join(value)
            elif kind == "table":
                row |= {"rows": [list(r) for r in value]}
                text = "\n".join(f"| {a} | {b} |" for a, b in value)
            else:
                row |= {"text": value, "level": more}
                text = value
            rows.append(tuple(row.get(n) for n in names))
            want.append((d, number, kind, more if kind == "title" else None, text))
            last, number = kind, number + 1
    markdown = render.render_blocks(spark.createDataFrame(rows, BLOCK)).withColumnRenamed("markdown", "text")
    again = blocks.blocks(structure.explode_lines(markdown)).select("doc_id", "block_no", "type", "level", "text")
    assert sorted(map(tuple, again.collect())) == sorted(want)
