"""What surrounds batch inference: inputs, enum values, fallback, document fields, retries and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import stripped

# The priorities, and the document types that have a schema.
PRIORITIES = ("high", "medium", "low")
SUPPORTED = ("srs", "hld", "api", "tc", "dbdd")


def document_outline(elements: DataFrame, topics: int = 12) -> DataFrame:
    """doc_id, sections (distinct, in first-seen order), main_topics (the first of them without leading numbers)."""
    first = elements.where("section is not null").groupBy("doc_id", "section").agg(F.min("ord").alias("ord"))
    found = first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "section"))), lambda x: x.section).alias("sections"))
    plain = F.transform("sections", lambda s: F.regexp_replace(F.element_at(F.split(s, " > "), -1), r"^\d+(\.\d+)*\.?\s*", ""))
    return found.withColumn("main_topics", F.slice(F.array_distinct(plain), 1, topics))


def summary_inputs(docs: DataFrame, outline: DataFrame, limit: int = 12000) -> DataFrame:
    """doc_id, text (single blanks, cut to the limit), outline (JSON; NULL without elements)."""
    plain = F.substring(stripped(F.regexp_replace("text", r"(?U)\s+", " ")), 1, limit)
    json = outline.select("doc_id", F.to_json(F.struct("sections", "main_topics")).alias("outline"))
    return docs.select("doc_id", plain.alias("text")).join(json, "doc_id", "left")


def normalized_enum(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The value in lower case without blanks around it; the default for others and NULL."""
    plain = F.lower(stripped(value))
    return F.when(plain.isin(*allowed), plain).otherwise(default)


def finalizer_fallback(final: DataFrame, partial: DataFrame) -> DataFrame:
    """A document's merged results where it has any, else all results of its chunks; both tables have the same columns."""
    return final.unionByName(partial.join(final.select("doc_id").distinct(), "doc_id", "left_anti").select(*final.columns))


def merge_document_fields(candidates: DataFrame, text: str, item: str) -> DataFrame:
    """doc_id, the longest value of `text` (the earlier of equals), the distinct values of `item` in first-seen order."""
    rank = F.when(F.col(text) != "", F.struct(F.length(stripped(F.col(text))), -F.col("seq")))
    first = candidates.groupBy("doc_id", item).agg(F.min("seq").alias("first"), F.max(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col(text)))).alias("best"))
    rows = F.array_sort(F.collect_list(F.when(F.col(item) != "", F.struct("first", item))))
    return first.groupBy("doc_id").agg(F.max("best").getField(text).alias(text), F.transform(rows, lambda x: x[item]).alias(f"{item}s"))


def first_evidence(bound: DataFrame) -> DataFrame:
    """The support of each document that a viewer shows first: one with text, else one with page (not 0) and box, else any.

    Of equals that of the first object, then of the first element. A document's supports meet by an aggregate, so many of
    them are no load for one task.
    """
    text = F.coalesce(stripped(F.col("text_span")) != "", F.lit(False))
    place = F.coalesce((F.col("page") != 0) & F.col("bbox").isNotNull(), F.lit(False)) if {"page", "bbox"} <= set(bound.columns) else F.lit(False)
    rank = F.struct(F.when(text, 0).when(place, 1).otherwise(2).alias("kind"), "object_id", "element_id", *(c for c in bound.columns if c not in ("doc_id", "object_id", "element_id")))
    return bound.groupBy("doc_id").agg(F.min(rank).alias("x")).select("doc_id", *(F.col(f"x.{c}") for c in bound.columns if c != "doc_id"))


def patch_objects(objects: DataFrame, patches: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The objects with the given fields of the patch that has their document, slot and id; a NULL changes nothing."""
    keys = ["doc_id", "slot", "object_id"]
    joined = objects.join(patches.select(*keys, *(F.col(f).alias(f"new_{f}") for f in fields)), keys, "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in objects.columns))


def retry_selection(catalog: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, doc_type, rebuild (no elements yet) of the documents that have text and a supported type."""
    eligible = catalog.where(F.col("doc_type").isin(*SUPPORTED) & (stripped(F.col("raw_text")) != ""))
    known = elements.select("doc_id").distinct().withColumn("known", F.lit(True))
    return eligible.join(known, "doc_id", "left").select("doc_id", "doc_type", F.col("known").isNull().alias("rebuild"))
