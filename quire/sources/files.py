"""Files to tables and tables to files: text corpora, typed JSON, the catalog, reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the upload accepts, and the source type of each extension.
ACCEPTED = {".pdf": "pdf", ".docx": "docx", ".md": "markdown", ".txt": "text"}


@F.pandas_udf(T.StringType())
def _gbk(content: pd.Series) -> pd.Series:
    """The bytes as GBK text; NULL where they are none."""
    def decoded(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else bytes(raw).decode("gbk")
        except UnicodeDecodeError:
            return None

    return content.map(decoded)


def scan_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """path, content, encoding and error of whole text files: UTF-8, or GBK where the bytes are no UTF-8.

    Spark lists and reads the files, from any store it knows; only bytes that are no UTF-8 go to Python. A file that is neither
    has a NULL content and an error. Files of other extensions are left out, and Spark lists no empty files.
    """
    files = spark.read.format("binaryFile").load(path).where(extension(F.col("path")).isin(".md", ".markdown", ".txt"))
    rows = files.select("path", F.col("content").alias("raw"), F.is_valid_utf8(F.col("content").cast("string")).alias("plain"))
    good = rows.where("plain").select("path", F.col("raw").cast("string").alias("content"), F.lit("utf-8").alias("encoding"))
    odd = rows.where("not plain").select("path", _gbk("raw").alias("content"), F.lit("gbk").alias("encoding"))
    error = F.when(F.col("content").isNull(), "neither UTF-8 nor GBK")
    return good.unionByName(odd).select("path", "content", F.when(error.isNull(), F.col("encoding")).alias("encoding"), error.alias("error"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def route_by_extension(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds extension, source_type and message (NULL for accepted files)."""
    kinds = F.create_map(*(F.lit(x) for pair in ACCEPTED.items() for x in pair))
    found = extension(F.col(path))
    return files.withColumns({"extension": found, "source_type": kinds[found], "message": F.when(~found.isin(*ACCEPTED), F.concat(F.lit("unsupported file type: "), found))})


def read_typed_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of JSON files in the schema of their type, with the file each comes from."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))


def manifest_join(manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """doc_path, gt_path, status: ok where a prediction is there; documents without one are left out, broken ones fail."""
    found = predictions.select("doc_path", F.col("broken").alias("broken"))
    return manifest.join(found, "doc_path").select("doc_path", "gt_path", F.when(F.col("broken"), "failed").otherwise("ok").alias("status"))


def write_catalog(catalog: DataFrame, path: str) -> None:
    """One folder for each doc_type; a later write replaces only the types it holds."""
    catalog.write.partitionBy("doc_type").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_report(path: str, **sections: DataFrame) -> None:
    """A JSON table for each section of an evaluation report."""
    for name, section in sections.items():
        section.write.mode("overwrite").json(f"{path}/{name}")
