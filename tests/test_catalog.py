"""The catalog, evidence spans and text files on hostile values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import catalog, objects
from quire.sources import files

CATALOG = "doc_id long, title string, raw_text string, document_ir string, extracted_data string, extraction_meta string"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "a", "t", "ir", "x", '{"n": 1}'), (2, "b", None, None, None, "{broken"), (3, "c", "t", "ir", "x", None)], CATALOG)


def test_list_keeps_large_columns_out(docs):
    got = catalog.list_documents(docs).select("doc_id", "has_raw_text", "has_document_ir", "has_extracted_data", F.try_variant_get("extraction_meta", "$.n", "int").alias("n"), F.col("extraction_meta").isNull().alias("none")).collect()
    assert [tuple(r) for r in got] == [(3, True, True, True, None, True), (2, False, False, False, None, True), (1, True, True, True, 1, False)]


def test_patches(spark, docs):
    rows = [(1, 1, "first", None), (1, 2, "second", None), (1, 3, None, "t"), (2, 1, None, "new"), (3, 1, None, None), (9, 1, "x", None), (None, 1, "x", None), (3, 2, None, "other")]
    patched, rejected = catalog.apply_patches(docs, spark.createDataFrame(rows, "doc_id long, patch_no int, title string, raw_text string"))
    assert sorted(map(tuple, patched.select("doc_id", "title", "raw_text", "document_ir", "extracted_data").collect())) == [(1, "second", "t", "ir", "x"), (2, "b", "new", None, None), (3, "c", "other", None, "x")]
    assert patched.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["patch_no"], r["reason"]) for r in rejected.collect()) == [(0, 1, "no id"), (3, 1, "no field"), (9, 1, "unknown document")]


def test_deletion_takes_children_along(spark, docs):
    children = spark.createDataFrame([(1, "el-1"), (3, "el-1"), (None, "el-2")], "doc_id long, element_id string")
    left = catalog.delete_documents(spark.createDataFrame([(1,), (1,), (None,)], "doc_id long"), catalog=docs, elements=children)
    assert sorted(r["doc_id"] for r in left["catalog"].collect()) == [2, 3]
    assert sorted(map(tuple, left["elements"].collect()), key=repr) == [(3, "el-1"), (None, "el-2")]


def test_spans_of_every_length_find_their_element(spark):
    rng = random.Random(3)
    bodies = ["".join(rng.choice("ab c中") for _ in range(rng.choice([0, 1, 2, 5, 40, 300]))) for _ in range(120)]
    elements = [(k % 4, k, f"el-{k}", b) for k, b in enumerate(bodies)] + [(9, 0, "el-0", None)]
    spans = []
    for k in range(150):
        body = rng.choice(bodies)
        at = rng.randrange(len(body) + 1)
        spans.append((rng.randrange(5), f"o{k}", "gone", rng.choice([body[at : at + rng.choice([1, 2, 3, 7, 8, 14, 15, 16, 60])].upper(), "zz", None, "　", "never in any of the texts"])))
    plain = lambda t: " ".join((t or "").split()).lower()
    want = {}
    for d, o, _, s in spans:
        fits = [e for e in elements if e[0] == d and plain(s) and plain(s) in plain(e[3])]
        want[o] = min(fits, key=lambda e: e[1])[2] if fits else None
    got = objects.resolve_targets(spark.createDataFrame(spans, "doc_id long, object_id string, element_id string, text_span string"), spark.createDataFrame(elements, "doc_id long, ord long, element_id string, text string"))
    assert {r["object_id"]: r["target"] for r in got.collect()} == want


def test_text_files_of_two_encodings(spark, tmp_path):
    for name, raw in {"a.md": "标题\n".encode(), "b.TXT": "中文标题，正文".encode("gbk"), "c.txt": b"\x81", "d.markdown": b"", "e.pdf": "中".encode("gbk"), "f.md": "plain".encode()}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[-1]: (r["content"], r["encoding"], r["error"]) for r in files.scan_text_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("标题\n", "utf-8", None), "b.TXT": ("中文标题，正文", "gbk", None), "c.txt": (None, None, "neither UTF-8 nor GBK"), "f.md": ("plain", "utf-8", None)}
