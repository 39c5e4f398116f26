"""The version of a document from its front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import cells, stripped

# Labels before a version, and what a version looks like.
LABELS = ("文档版本", "版本", "version", "doc version", "document version")
VERSION = r"^[vV]?\d+(?:[._-]\d+)*(?:[-+][0-9A-Za-z.-]+)?$"


def _label(cell: Column) -> Column:
    return F.lower(F.regexp_replace(stripped(F.regexp_replace(cell, r"[*_`]", "")), r"(?U)\s+", " "))


def version_value(value: Column) -> Column:
    """The first word of the value without emphasis and end marks, if it looks like a version; else NULL."""
    plain = F.regexp_replace(stripped(F.regexp_replace(value, r"[*_`]", "")), r"^[。；;,，]+|[。；;,，]+$", "")
    word = F.regexp_extract(plain, r"(?U)^\s*(\S+)", 1)
    return F.when(word.rlike(VERSION), word)


def line_version(line: Column) -> Column:
    """The version that a line gives: in the cell after a label, or after a label and a colon."""
    body = stripped(line)
    parts = cells(body)
    at = F.array_position(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda c: F.array_contains(F.array(*map(F.lit, LABELS)), _label(c))), True)
    in_table = F.when(body.startswith("|") & body.endswith("|") & (at > 0), version_value(F.get(parts, at.cast("int"))))
    after = F.regexp_extract(line, rf"(?iU)^\s*(?:{'|'.join(LABELS)})\s*[:：]\s*(.+?)\s*$", 1)
    return F.coalesce(in_table, F.when(after != "", version_value(after)))


def extract_version(front: DataFrame) -> DataFrame:
    """doc_id, version of the first line of text that gives one."""
    lines = front.select("doc_id", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("n", "line"))
    found = lines.select("doc_id", "n", line_version(F.col("line")).alias("version")).where("version is not null")
    return found.groupBy("doc_id").agg(F.min_by("version", "n").alias("version"))


def fill_missing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the found version where their own is NULL or empty."""
    new = found.select("doc_id", F.col("version").alias("found_version"))
    return docs.join(new, "doc_id", "left").withColumn("version", F.coalesce(F.nullif("version", F.lit("")), "found_version")).drop("found_version")
