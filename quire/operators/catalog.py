"""The document catalog: light lists, search, facets, patches, deletion, and the current status from a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIVE = ("pending", "uploaded", "parsing", "extracting")


#: Columns that are large, and of which a list only says whether they are there.
LARGE = ("raw_text", "document_ir", "extracted_data")


def list_documents(catalog: DataFrame) -> DataFrame:
    """Light columns, newest id first; a large one is only a flag. extraction_meta (JSON) is a VARIANT, NULL where it is none."""
    flags = [F.col(c).isNotNull().alias(f"has_{c}") for c in LARGE if c in catalog.columns]
    light = [F.try_parse_json(c).alias(c) if c == "extraction_meta" else F.col(c) for c in catalog.columns if c not in LARGE]
    return catalog.select(*light, *flags).orderBy(F.desc("doc_id"))


def search_documents(catalog: DataFrame, keyword: str = "", statuses: tuple = (), types: tuple = ()) -> DataFrame:
    """Title contains the keyword in any case, or the id equals it; and the status and type are among those given."""
    out = catalog
    if keyword:
        hit = F.contains(F.lower("title"), F.lit(keyword.lower()))
        out = out.where(hit | (F.col("doc_id") == int(keyword)) if keyword.isdigit() else hit)
    if statuses:
        out = out.where(F.col("status").isin(*statuses))
    return out.where(F.col("doc_type").isin(*types)) if types else out


def facets(catalog: DataFrame) -> DataFrame:
    """facet, value, n of statuses and types that are not empty, in one pass."""
    pair = F.explode(F.array(F.struct(F.lit("status").alias("facet"), F.col("status").alias("value")), F.struct(F.lit("doc_type").alias("facet"), F.col("doc_type").alias("value")))).alias("x")
    return catalog.select(pair).select("x.facet", "x.value").where("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def apply_patches(catalog: DataFrame, patches: DataFrame, fields: tuple[str, ...] = ("title", "raw_text", "summary", "extracted_data")) -> tuple[DataFrame, DataFrame]:
    """The patched catalog, and the patches that were rejected, with a reason.

    A patch has doc_id, those of the fields that it may give (NULL: not given) and, where one document may have several,
    patch_no: of those the last that gives a field counts. A text other than the one before makes document_ir NULL, as it
    no longer fits; extracted_data stays. Rejected are patches without an id or a field, and those of unknown documents.
    """
    given = [f for f in fields if f in patches.columns and f in catalog.columns]
    number = F.col("patch_no") if "patch_no" in patches.columns else F.lit(0)
    said = sum((F.col(f).isNotNull().cast("int") for f in given), F.lit(0))
    known = catalog.select("doc_id", F.lit(True).alias("known")).distinct()
    judged = patches.join(known, "doc_id", "left").withColumn("reason", F.when(F.col("doc_id").isNull(), "no id").when(said == 0, "no field").when(F.col("known").isNull(), "unknown document")).drop("known")
    new = judged.where("reason is null").groupBy("doc_id").agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), number)).alias(f"new_{f}") for f in given))
    joined = catalog.join(new, "doc_id", "left")
    out = {f: F.coalesce(f"new_{f}", f) for f in given}
    if "raw_text" in given and "document_ir" in catalog.columns:
        changed = F.col("new_raw_text").isNotNull() & ~F.col("new_raw_text").eqNullSafe(F.col("raw_text"))
        out["document_ir"] = F.when(~changed, F.col("document_ir"))
    return joined.withColumns(out).select(*catalog.columns), judged.where("reason is not null")


def delete_documents(ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of those documents: the catalog, and what hangs on a document (elements, chunks, objects, evidence)."""
    gone = ids.select("doc_id").where("doc_id is not null").distinct()
    return {name: rows.join(gone, "doc_id", "left_anti").select(*rows.columns) for name, rows in tables.items()}


def latest_status(log: DataFrame) -> DataFrame:
    """doc_id, status, ts, active of the latest entry of each document; also a streaming aggregation in update mode."""
    latest = log.groupBy("doc_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))
    return latest.withColumn("active", F.col("status").isin(*ACTIVE))
