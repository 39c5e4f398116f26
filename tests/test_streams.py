"""Streams over several batches: failing documents, ways through the statuses, changed documents only, compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.streaming import ingest


def batches(spark, path, schema, *parts):
    """A stream with a batch for each part."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_a_failing_document_does_not_fail_its_batch(spark, tmp_path):
    def refusing(request):
        if "bad" in request:
            raise ValueError("refused")
        return f"{len(request)}"

    schema = "doc_id long, source string, text string"
    first = [(1, "s", "fine\nmore"), (2, "s", "bad words"), (3, "s", None), (4, "s", "　\n"), (5, "s", "first\n" + "y" * 60 + "\nbad\nlast")]
    second = [(6, None, "later"), (None, "s", "no id"), (7, "s", "bad"), (7, "s", "bad")]
    stream = batches(spark, tmp_path / "in", schema, first, second)
    out = str(tmp_path / "out")
    ingest.stream_ingest(stream, out, str(tmp_path / "checkpoint"), refusing, max_chars=80, tasks=2, pool=2)
    ways = {}
    for r in spark.read.parquet(f"{out}/status").orderBy("step").collect():
        ways.setdefault(r["doc_id"], []).append(r["status"])
    whole, refused, empty = ["uploaded", "parsing", "extracting", "completed"], ["uploaded", "parsing", "extracting", "failed"], ["uploaded", "parsing", "failed"]
    assert ways[1] == ways[6] == whole and ways[2] == ways[5] == ways[7] == refused and ways[3] == ways[4] == empty
    gone = {r["doc_id"]: (r["step"], r["error"]) for r in spark.read.parquet(f"{out}/quarantine").collect()}
    assert gone[3] == gone[4] == ("parsing", "no text") and gone[2][0] == gone[7][0] == "extracting"
    assert gone[5][1].startswith("chunk failed: chunk-0003") and gone[5][1].endswith("ValueError: refused")
    assert {r["doc_id"] for r in spark.read.parquet(f"{out}/responses").collect()} == {1, 6} and set(gone) == {None, 2, 3, 4, 5, 7} and gone[None][1] == "no id" and ways[None] == empty
    assert spark.read.parquet(f"{out}/arrived").select("batch").distinct().count() == 2


def test_status_batches_write_what_changed(spark, tmp_path):
    schema = "doc_id long, status string, ts long"
    parts = [[(1, "uploaded", 1), (2, "uploaded", 1)], [(1, "parsing", 2)], [(1, "completed", 5), (3, "pending", 3)], [(2, "failed", 4), (1, "extracting", 3)], [(3, "uploaded", 9)]]
    out = str(tmp_path / "out")
    ingest.stream_status(batches(spark, tmp_path / "in", schema, *parts), out, str(tmp_path / "checkpoint"), compact=0)
    sizes = sorted(spark.read.parquet(f"{out}/upto={k}").count() for k in range(5))
    assert sizes == [1, 1, 2, 2, 2] and {r["doc_id"]: (r["status"], r["ts"], r["active"]) for r in ingest.current_status(spark, out).collect()} == {1: ("completed", 5, False), 2: ("failed", 4, False), 3: ("uploaded", 9, True)}
    compacted = str(tmp_path / "compacted")
    ingest.stream_status(batches(spark, tmp_path / "again", schema, *parts), compacted, str(tmp_path / "checkpoint2"), compact=2)
    names = {p.name for p in (tmp_path / "compacted").iterdir() if p.is_dir()}
    assert names == {"upto=2", "whole=2", "upto=3", "upto=4", "whole=4"}
    assert sorted(map(tuple, ingest.current_status(spark, compacted).collect())) == sorted(map(tuple, ingest.current_status(spark, out).collect()))
