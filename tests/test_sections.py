"""Lines and sections: long documents, stacks of titles, field labels, contracts."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import blocks, responses, schemas, structure


def test_paths_are_those_of_a_stack(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for d in range(80):
        stack = []
        for b in range(rng.choice([1, 5, 60])):
            kind, level, text = rng.choice(["title", "title", "paragraph"]), rng.choice([None, 0, 1, 2, 3, 4, 6, 9]), rng.choice(["A", "B ", "　", "", "**优先级**：", "# 功能点"])
            doc_type = "SRS" if d % 2 else "api"
            rows.append((d, b, kind, level, text, doc_type))
            plain = text.strip().lstrip("# ").replace("*", "").rstrip(":： ")
            if kind == "title" and text.strip() and not (doc_type == "SRS" and plain in blocks.FIELD_LABELS):
                stack = stack[: min(max(level or 1, 1), 6) - 1] + [text.strip()]
            want[d, b] = list(stack)
    frame = spark.createDataFrame(rows, "doc_id long, block_no int, type string, level int, text string, doc_type string").withColumn("path", F.lit("clash"))
    assert {(r["doc_id"], r["block_no"]): r["section_path"] for r in blocks.section_paths(frame).collect()} == want


def test_no_blocks_have_no_paths(spark):
    assert blocks.section_paths(spark.createDataFrame([], "doc_id long, block_no int, type string, level int, text string")).collect() == []


def test_a_long_document_is_classified_in_seconds(spark):
    lines = spark.range(100_000).select(F.lit(1).alias("doc_id"), (F.col("id") + 1).alias("line_no"), F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 5 == 1, F.concat((F.col("id") % 97).cast("string"), F.lit(". item"))).otherwise("text").alias("line"))
    started = time.perf_counter()
    assert blocks.blocks(lines).count() > 10_000
    assert time.perf_counter() - started < 60


def test_contracts_of_every_type(spark):
    docs = spark.createDataFrame([(1, "hld"), (2, " TC "), (3, "dbdd"), (4, "odd"), (5, None)], "doc_id long, doc_type string")
    got = {r["doc_id"]: r["contract"] for r in responses.with_contracts(docs, {t: schemas.schema_of(t) for t in schemas.TYPES}).collect()}
    assert got[1]["target_slots"] == ["modules", "core_flows", "design_decisions"] and got[1]["document_fields"] == ["architecture_style", "technology_stack"]
    assert got[2]["doc_type"] == "tc" and got[2]["target_slots"] == ["test_cases"] and got[3]["document_fields"] == ["db_name", "db_type"]
    assert len(got[1]["rules"]) == 5 and "glossary" in got[1]["ignore_sections"] and got[4] is None and got[5] is None


@pytest.mark.parametrize("text,want", [("性能", "performance"), (" 可扩展性　", "scalability"), ("Security ", "security"), ("other", "other"), ("快", "other"), (None, "other")])
def test_categories(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(schemas.category(F.col("t"))).first()[0] == want


def test_front_matter_of_documents_is_that_of_their_elements(spark):
    docs = spark.createDataFrame([(1, "ab\n\n　\ncd\r\nefgh\ni" * 3, "s"), (2, None, "s"), (3, " \n", "s"), (4, "x" * 30, None), (None, "none", "s")], "doc_id long, text string, source string")
    for limit in (1, 2, 5, 11, 1000):
        want = sorted(map(tuple, structure.front_matter(structure.build_elements(docs), limit).collect()), key=repr)
        assert sorted(map(tuple, structure.front_matter_of(docs, limit).collect()), key=repr) == want
