"""Candidates to merged objects with ids, and the elements that support them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import layout, merging
from .blocks import stripped

# Id prefixes by slot; other slots take their first four letters.
PREFIXES = {"functional_requirements": "FREQ", "non_functional_requirements": "NFR", "business_flows": "BFL", "apis": "APIS", "modules": "MOD", "core_flows": "CFL", "design_decisions": "DEC", "test_cases": "TC", "tables": "TBL"}

# Slots whose objects are calls, and the field that labels an object's type, by slot.
CALLED = ("apis", "interfaces", "endpoints")
TYPE_LABELS = {"functional_requirements": "priority", "non_functional_requirements": "category", "apis": "method", "test_cases": "priority"}


def object_identity(candidates: DataFrame) -> DataFrame:
    """Adds object_key to doc_id, slot, seq and either item or the fields of the records (see merging.identity)."""
    if "item" in candidates.columns:
        return candidates.withColumn("object_key", merging.identity(F.col("slot"), F.col("item"), candidates.schema["item"].dataType))
    kind = T.StructType([f for f in candidates.schema if f.name not in ("doc_id", "slot", "seq")])
    item = merging.cleaned(F.struct(*kind.names), kind)
    return candidates.withColumn("object_key", merging.identity(F.col("slot"), item, kind))


def merge_objects(keyed: DataFrame) -> DataFrame:
    """doc_id, slot, object_key, first_seq, name, description (each the longest, the earlier of equals), candidates and evidence_ids.

    evidence_ids are the distinct ids that the candidates name, in order, where the candidates have an evidence_id.
    """
    seq = F.col("seq")
    named = [F.array_sort(F.collect_set(F.nullif(stripped(F.col("evidence_id")), F.lit("")))).alias("evidence_ids")] if "evidence_id" in keyed.columns else []
    return keyed.groupBy("doc_id", "slot", "object_key").agg(F.min("seq").alias("first_seq"), merging.longest(F.col("name"), seq).alias("name"), merging.longest(F.col("description"), seq).alias("description"), F.count("*").alias("candidates"), *named)


def assign_ids(objects: DataFrame) -> DataFrame:
    """Adds object_id: the slot's prefix and a number in first-seen order within the document and slot."""
    prefix = F.upper(F.substring("slot", 1, 4))
    for slot, short in PREFIXES.items():
        prefix = F.when(F.col("slot") == slot, short).otherwise(prefix)
    n = F.row_number().over(Window.partitionBy("doc_id", "slot").orderBy("first_seq"))
    return objects.withColumn("object_id", F.concat(prefix, F.lit("-"), F.format_string("%03d", n)))


def object_evidence(objects: DataFrame) -> DataFrame:
    """doc_id, object_id, evidence_id: a row for each id that an object names."""
    return objects.select("doc_id", "object_id", F.explode("evidence_ids").alias("evidence_id"))


def bind_evidence(named: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, object_id, element_id, text_span (single blanks, cut to 500; NULL for none) and, where the elements have them, page and bbox.

    One row for each id that an object names and that exists in its document, with what the element says and where it is.
    Element ids are unique in their document.
    """
    plain = stripped(F.regexp_replace("text", r"(?U)\s+", " "))
    span = F.nullif(shortened(plain, 500), F.lit(""))
    place = [c for c in ("page", "bbox") if c in elements.columns]
    spans = elements.select("doc_id", "element_id", span.alias("text_span"), *(layout.valid_box(F.col(c)).alias(c) if c == "bbox" else F.col(c) for c in place))
    ids = named.select("doc_id", "object_id", F.col("evidence_id").alias("element_id")).distinct()
    return ids.join(spans, ["doc_id", "element_id"]).select("doc_id", "object_id", "element_id", "text_span", *place)


def valid_evidence(objects: DataFrame, bound: DataFrame) -> DataFrame:
    """The objects with evidence_element_ids: the ordered ids of what supports them, those that exist only."""
    found = bound.groupBy("doc_id", "object_id").agg(F.array_sort(F.collect_set("element_id")).alias("evidence_element_ids"))
    rows = objects.drop("evidence_element_ids").join(found, ["doc_id", "object_id"], "left")
    return rows.withColumn("evidence_element_ids", F.coalesce("evidence_element_ids", F.array().cast("array<string>")))


def dangling_evidence(named: DataFrame, elements: DataFrame) -> DataFrame:
    return named.join(elements.select("doc_id", F.col("element_id").alias("evidence_id")), ["doc_id", "evidence_id"], "left_anti").select("doc_id", "object_id", "evidence_id")


def evidence_coverage(objects: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, evidence_count, objects_total, objects_with_evidence, coverage (four decimals): how many of the named ids exist.

    The objects have evidence_ids and are read once; element ids are unique in their document.
    """
    known = elements.select("doc_id", F.col("element_id").alias("evidence_id"), F.lit(1).alias("known"))
    named = objects.select("doc_id", "object_id", F.explode_outer("evidence_ids").alias("evidence_id")).join(known, ["doc_id", "evidence_id"], "left")
    each = named.groupBy("doc_id", "object_id").agg(F.count("known").alias("n"))
    sums = each.groupBy("doc_id").agg(F.sum("n").alias("evidence_count"), F.count("*").alias("objects_total"), F.count_if(F.col("n") > 0).alias("objects_with_evidence"))
    return sums.withColumn("coverage", F.round(F.col("objects_with_evidence") / F.col("objects_total"), 4))


def collect_candidates(results: DataFrame, slots: tuple[str, ...]) -> DataFrame:
    """doc_id, slot, seq (dense, from 1), item: the cleaned records of the slots that say something besides their id and evidence."""
    out = None
    for slot in slots:
        rows = results.select("doc_id", F.lit(slot).alias("slot"), "chunk_no", F.posexplode(slot).alias("pos", "item"))
        rows = merging.cleaned_records(rows)
        out = rows if out is None else out.unionByName(rows)
    seq = F.row_number().over(Window.partitionBy("doc_id", "slot").orderBy("chunk_no", "pos"))
    return out.withColumn("seq", seq.cast("long")).select("doc_id", "slot", "seq", "item")


def union_lists(rows: DataFrame, column: str) -> DataFrame:
    """doc_id, column: the lists of a document in order of seq, one after the other, each value where it comes first."""
    first = rows.select("doc_id", "seq", F.posexplode(column).alias("pos", "value")).groupBy("doc_id", "value").agg(F.min(F.struct("seq", "pos")).alias("at"))
    return first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x.value).alias(column))


def extraction_meta(coverage: DataFrame, chunks: DataFrame, elements: DataFrame, model: str = "") -> DataFrame:
    """doc_id, llm_model, confidence (the coverage), chunk, failed-chunk, element and section counts.

    chunks has doc_id and failed, elements doc_id and section. Documents without elements have no row.
    """
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.count_if("failed").alias("failed_chunks"))
    e = elements.groupBy("doc_id").agg(F.count("*").alias("element_count"), F.count_distinct("section").alias("section_count"))
    out = e.join(c, "doc_id", "left").join(coverage.select("doc_id", F.col("coverage").alias("confidence")), "doc_id", "left").withColumn("llm_model", F.lit(model))
    return out.na.fill(0, ["chunk_count", "failed_chunks"]).na.fill(0.0, ["confidence"])


def shortened(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("..."))).otherwise(text)


def _shown(objects: DataFrame) -> tuple[Column, Column]:
    """The title and the type label of an object, by the fields that the objects or their item have."""
    inside = objects.schema["item"].dataType.names if "item" in objects.columns else []

    def said(field: str) -> Column:
        value = F.col("item")[field] if field in inside else F.col(field) if field in objects.columns else F.lit(None)
        return F.nullif(stripped(value.cast("string")), F.lit(""))

    call = F.nullif(F.concat_ws(" ", F.coalesce(said("method"), said("http_method")), F.coalesce(said("endpoint"), said("path"))), F.lit(""))
    title = F.coalesce(said("name"), F.when(F.col("slot").isin(*CALLED), call), F.when(F.col("slot") == "auth", said("auth_type")), said("title"), *(shortened(said(f), 48) for f in ("description", "summary", "content")), F.col("object_id"))
    label = reduce(lambda found, pair: F.when(F.col("slot") == pair[0], said(pair[1])).otherwise(found), TYPE_LABELS.items(), F.lit(None).cast("string"))
    return title, label


def item_view(objects: DataFrame, bound: DataFrame) -> DataFrame:
    """doc_id, object_id, slot, title, type_label, evidence: a row of a list of objects.

    The title is the name, else method and path of a call, the kind of an auth, a title, or what else an object says, cut to
    48; else its id. evidence has a record (element_id and, where known, text_span, page, bbox) for each support, by element.
    """
    title, label = _shown(objects)
    record = F.struct("element_id", *(c for c in ("text_span", "page", "bbox") if c in bound.columns))
    found = bound.groupBy("doc_id", "object_id").agg(F.array_sort(F.collect_set(record)).alias("evidence"))
    none = F.array().cast(found.schema["evidence"].dataType)
    return objects.join(found, ["doc_id", "object_id"], "left").select("doc_id", "object_id", "slot", title.alias("title"), label.alias("type_label"), F.coalesce("evidence", none).alias("evidence"))


def _grams(text: str, size: int, window: int, first: bool) -> np.ndarray:
    """Of each window of neighbouring n-grams the one of least hash: a text that holds another has all that the other has.

    first: only the one of the first window.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < size + window - 1:
        return np.zeros(0, np.int64)
    codes = codes[: size + window - 1] if first else codes
    grams = np.zeros(len(codes) - size + 1, np.uint64)
    for k in range(size):
        grams = (grams ^ codes[k : k + len(grams)]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    return np.unique(np.lib.stride_tricks.sliding_window_view(grams, window).min(1)).view(np.int64)


#: n-grams by which spans find their elements (length, window): spans of fewer than length + window - 1 characters go to the next.
GRAMS = ((8, 8), (3, 1), (1, 1))
#: Spans of a document up to which its elements are compared with each of them: the work grows with the elements only.
FEW = 64


def _marked(text: str, level: int, first: bool) -> np.ndarray:
    """The n-grams of a level, which is in their low bits."""
    return _grams(text, *GRAMS[level], first) << 2 | level


@F.pandas_udf(T.LongType())
def _span_gram(spans: pd.Series, levels: pd.Series) -> pd.Series:
    return pd.Series([_marked(t, k, True)[0] for t, k in zip(spans, levels, strict=True)], dtype="int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _body_grams(bodies: pd.Series, levels: pd.Series) -> pd.Series:
    """Of each text the n-grams of the levels that are asked for, a bit each."""
    return pd.Series([np.concatenate([_marked(t, k, False) for k in range(len(GRAMS)) if asked >> k & 1]).tolist() for t, asked in zip(bodies, levels, strict=True)], dtype=object)


def resolve_targets(evidence: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, object_id, element_id, target: the element with the id, else the first whose text holds the span; else NULL.

    Elements have ord. Texts are compared in lower case with single blanks. The elements of a document with few spans are
    compared with each of these; else a span meets only the elements that have one of its n-grams. A span without a character
    finds nothing.
    """
    known = elements.select("doc_id", "element_id").distinct().withColumn("target", F.col("element_id"))
    rows = evidence.join(known, ["doc_id", "element_id"], "left")
    size = F.length("span")
    level = reduce(lambda found, k: F.when(size >= sum(GRAMS[k]) - 1, k).otherwise(found), reversed(range(len(GRAMS) - 1)), F.lit(len(GRAMS) - 1))
    loose = rows.where("target is null").select("doc_id", "object_id", "element_id", merging.plain(F.col("text_span")).alias("span")).where("span <> ''").withColumn("level", level)
    bodies = elements.select("doc_id", "ord", F.col("element_id").alias("held_by"), merging.plain(F.col("text")).alias("body"))
    asked = loose.groupBy("doc_id").agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1, level)")).alias("levels"))
    few, many = asked.where(F.col("n") <= FEW).select("doc_id"), asked.where(F.col("n") > FEW)
    compared = loose.join(few, "doc_id").join(bodies, "doc_id")
    # Deterministic, they would go below the joins for a filter, and so over all rows.
    span_gram, body_grams = _span_gram.asNondeterministic(), _body_grams.asNondeterministic()
    spans = loose.join(many.select("doc_id"), "doc_id").distinct().withColumn("gram", span_gram("span", "level"))
    index = bodies.join(many.select("doc_id", "levels"), "doc_id").withColumn("gram", F.explode_outer(body_grams("body", "levels")))
    met = spans.join(index, ["doc_id", "gram"])
    columns = ("doc_id", "object_id", "element_id", "ord", "held_by")
    held = reduce(DataFrame.union, (found.where(F.contains("body", "span")).select(*columns) for found in (compared, met)))
    held = held.groupBy("doc_id", "object_id", "element_id").agg(F.min_by("held_by", "ord").alias("held_by"))
    return rows.join(held, ["doc_id", "object_id", "element_id"], "left").select("doc_id", "object_id", "element_id", F.coalesce("target", "held_by").alias("target"))


def targets_by_element(bound: DataFrame) -> DataFrame:
    """doc_id, element_id, objects (ordered ids of what it supports)."""
    return bound.groupBy("doc_id", "element_id").agg(F.array_sort(F.collect_set("object_id")).alias("objects"))
