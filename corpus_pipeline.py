"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again before the next stage. All but
the last keep the columns of documents. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import minhash, packing, quality, suffix_dedup, surrogates
from quire.llm.common import documents_in, dropped, held_out, new_path
from quire.llm.queries import END_ID, WORD_BPE
from quire.session import ready


def _begin(spark: SparkSession) -> None:
    """The stage before has been written and read again, so the tables of its steps can go."""
    dropped(ready(spark))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    _begin(spark)
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out(F.col("doc_id"), 4, 2))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: a similarity of 0.8 and more on five-word shingles."""
    _begin(spark)
    return minhash.without_near_duplicates(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of passages of 200 bytes and more."""
    _begin(spark)
    return suffix_dedup.without_later_copies(docs, 200)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    _begin(spark)
    return surrogates.replaced(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    _begin(spark)
    return packing.packed(docs, WORD_BPE, END_ID)


STAGES = [("quality", good), ("near_duplicates", distinct), ("repeated_passages", unrepeated), ("surrogates", private), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_in(spark, sf_dir)
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
