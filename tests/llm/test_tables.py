"""The operators on the given tables: places in shards, pieces of packed documents, held-out ranking, stages on no rows."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import minhash, packing, quality, token_shards
from quire.llm.common import documents_in, held_out
from quire.llm.queries import END_ID, WORD_BPE


def test_starts_in_shards_are_sums_before(spark, sf_dir):
    rows = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in token_shards.token_shards(documents_in(spark, sf_dir), WORD_BPE, END_ID).collect())
    before = np.cumsum([0, *(n for _, _, n in rows)])
    assert [s for _, s, _ in rows] == before[:-1].tolist()


def test_pieces_are_whole_documents_cut(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = {r["doc_id"]: r["text"] for r in documents_in(spark, sf_dir).select("doc_id", "text").collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.packed(documents_in(spark, sf_dir), WORD_BPE, END_ID, 4096).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc, found in pieces.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, END_ID], "<u4")
        at = 0
        for start, length, crc, tokens in sorted(found):
            assert (start, tokens) == (at, len(ids)) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for found in sequences.values():
        ends = np.cumsum([0, *(n for _, n in sorted(found))])
        assert [o for o, _ in sorted(found)] == ends[:-1].tolist() and ends[-1] <= 4096


def test_held_out_documents_are_ranked_by_quality(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.scored(documents_in(spark, sf_dir), labels, held_out(F.col("doc_id"), 4, 2))
    rows = found.where("held_out").join(labels.where("quality is not null"), "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 10 and len(bad) > 10
    ranked = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert ranked >= 0.9


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_no_rows(spark, sf_dir, name, stage):
    docs = documents_in(spark, sf_dir).where("false")
    out = stage(spark, docs, sf_dir)
    assert out.collect() == []
    assert name == "packing" or out.columns == docs.columns


def test_near_duplicates_with_clashing_columns(spark, docs):
    clash = docs.withColumns({c: F.lit(1) for c in ("c", "h1", "h2", "n", "u", "v", "key", "component", "n_shingles", "kept")})
    plain = sorted(map(repr, minhash.without_near_duplicates(docs).select("doc_id", "text").collect()))
    got = minhash.without_near_duplicates(clash)
    assert sorted(map(repr, got.select("doc_id", "text").collect())) == plain and got.columns == clash.columns
