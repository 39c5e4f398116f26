"""Elements to chunks of bounded size, whole sections first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .blocks import stripped


def render_markers(elements: DataFrame) -> DataFrame:
    """Adds marked (a line with the id and page, then the body) and size (its characters)."""
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(" page="), F.col("page").cast("string"))).otherwise("")
    marked = stripped(F.concat(F.lit("[ELEMENT: "), "element_id", page, F.lit("]\n"), stripped(F.col("text"))))
    return elements.withColumn("marked", marked).withColumn("size", F.length("marked").cast("long"))


def section_units(sized: DataFrame) -> DataFrame:
    """Adds unit_no (from 1; a new one wherever the section or group_no changes), unit_size and opens (first of its unit)."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    key = F.struct(*(c for c in ("section", "group_no") if c in sized.columns))
    changed = ~F.coalesce(F.lag(key).over(order).eqNullSafe(key), F.lit(False)) | (F.row_number().over(order) == 1)
    numbered = sized.withColumn("opens", changed).withColumn("unit_no", F.sum(F.col("opens").cast("long")).over(order))
    return numbered.withColumn("unit_size", F.sum("size").over(Window.partitionBy("doc_id", "unit_no")))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _starts(ords: pd.Series, sizes: pd.Series, limit: pd.Series) -> pd.Series:
    """The ord of the items at which a new chunk begins: next fit by sums of sizes, one search for each chunk."""
    out = []
    for own, size, most in zip(ords, sizes, limit, strict=True):
        past, at, found = np.cumsum(np.asarray(size, np.int64)), 0, []
        while at < len(past):
            found.append(int(own[at]))
            room = int(most) + (int(past[at - 1]) if at else 0)
            at = max(at + 1, int(np.searchsorted(past, room, side="right")))
        out.append(found)
    return pd.Series(out)


def chunk_numbers(units: DataFrame, limit: int) -> DataFrame:
    """Adds chunk_no (from 1): next fit by whole units within a group; a unit over the limit stands apart and is cut between elements.

    Stretches of units that may share a chunk end at a unit over the limit and at each change of group_no. The packing sees
    the sizes of one stretch: of its units, or of the elements of the one unit that is too large.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    group = F.col("group_no") if "group_no" in units.columns else F.lit(0)
    rows = units.withColumn("big", F.col("unit_size") > limit).withColumn("group", group)
    apart = F.col("big") | F.coalesce(F.lag("big").over(order), F.lit(True)) | ~F.lag("group").over(order).eqNullSafe(F.col("group"))
    rows = rows.withColumn("parts", F.col("opens") & apart).withColumn("stretch", F.sum(F.col("parts").cast("long")).over(order))
    item = F.struct("ord", F.when(F.col("big"), F.col("size")).otherwise(F.col("unit_size")).cast("long").alias("size"))
    packed = rows.where("big or opens").groupBy("doc_id", "stretch").agg(F.array_sort(F.collect_list(item)).alias("x"))
    starts = packed.select("doc_id", F.explode(_starts(F.col("x.ord"), F.col("x.size"), F.lit(limit))).alias("ord")).withColumn("starts", F.lit(1))
    return rows.join(starts, ["doc_id", "ord"], "left").withColumn("chunk_no", F.sum("starts").over(order)).drop("big", "group", "parts", "stretch", "starts")


def chunk_summary(chunked: DataFrame) -> DataFrame:
    """doc_id, chunk_id, section of the first element, elements, chars, page_start, page_end, first_element, last_element, element_ids and markdown (the marked bodies, a blank line between them)."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "element_id", "marked")))
    found = chunked.groupBy("doc_id", "chunk_no").agg(F.min_by("section", "ord").alias("section"), F.count("*").alias("elements"), F.sum("size").alias("chars"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), rows.alias("rows"))
    ids = F.col("rows.element_id")
    return found.select("doc_id", F.format_string("chunk-%04d", "chunk_no").alias("chunk_id"), "section", "elements", "chars", "page_start", "page_end", F.get(ids, F.lit(0)).alias("first_element"), F.element_at(ids, -1).alias("last_element"), ids.alias("element_ids"), F.array_join(F.col("rows.marked"), "\n\n").alias("markdown"))


def overlap(chunked: DataFrame, limit: int) -> DataFrame:
    """doc_id, chunk_no, ord of the elements put before each chunk but the first: the longest tail of at most limit characters.

    By sums of sizes, an element before a chunk belongs to its overlap just when the sizes from it to the chunk's start fit.
    Sums are cut into bins of the limit, so an element meets the chunks of its own bin and the next one only.
    """
    order = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    summed = chunked.select("doc_id", "ord", "chunk_no", (F.sum("size").over(order) - F.col("size")).alias("past"))
    starts = summed.groupBy("doc_id", "chunk_no").agg(F.min("ord").alias("start"), F.min("past").alias("before")).where("chunk_no > 1").withColumn("bin", F.floor(F.col("before") / limit))
    own = F.floor(F.col("past") / limit)
    e = summed.select("doc_id", F.col("ord").alias("e_ord"), F.col("past").alias("e_past"), F.explode(F.array(own, own + 1)).alias("bin"))
    return starts.join(e, ["doc_id", "bin"]).where((F.col("e_ord") < F.col("start")) & (F.col("before") - F.col("e_past") <= limit)).select("doc_id", "chunk_no", F.col("e_ord").alias("ord"))
