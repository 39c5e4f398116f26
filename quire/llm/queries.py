"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, caps, fingerprints, hamming, lattice, minhash, packing, quality, suffix_dedup, surrogates, token_shards, variants, whitening
from .common import documents_in, held_out, written

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2
#: The share of a union that links two documents, in percent.
NEAR_PERCENT = 85


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_shards(documents_in(spark, sf_dir), WORD_BPE, END_ID)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents_in(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out(F.col("doc_id"), 4, 2))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(documents_in(spark, sf_dir), 200)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(documents_in(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents_in(spark, sf_dir), WORD_BPE, END_ID, 4096)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents_in(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.replaced(documents_in(spark, sf_dir))
    return found.select("doc_id", F.size("entity_types").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("entity_types")), ",").alias("types"), "text")


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scored(documents_in(spark, sf_dir), PIECES, held_out(F.col("doc_id"), 5, 1))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents_in(spark, sf_dir), NEAR_PERCENT)


def op10_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(hamming.codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"), "codes")
    return hamming.top_k(rows, rows.where("id % 100 = 0"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 32)


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(documents_in(spark, sf_dir))


def op13_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 0.9)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
