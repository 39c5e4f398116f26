"""The pipeline's stages on whole small tables, against brute force."""

import re

import numpy as np
from test_minhash import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm.queries import END_ID, WORD_BPE

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality"](spark, docs, SF).cache()
    assert first.columns == docs.columns and 0 < first.count() < docs.count() and first.exceptAll(docs).count() == 0

    rows = [(r.doc_id, r.text) for r in first.collect()]
    component, _ = brute_components(rows, 80)
    second = stages["near_duplicates"](spark, first, SF).cache()
    assert second.columns == docs.columns and sorted(r.doc_id for r in second.collect()) == sorted(i for (i, _), c in zip(rows, component, strict=True) if i == c)

    third = stages["repeated_passages"](spark, second, SF).cache()
    before, after = ({r.doc_id: r.text.encode() for r in x.collect()} for x in (second, third))
    seen, left = {}, {}
    for i in sorted(before):  # a byte goes if a window over it lies earlier in the table
        cover = np.zeros(len(before[i]), bool)
        for s in range(len(before[i]) - 199):
            if seen.setdefault(before[i][s : s + 200], (i, s)) != (i, s):
                cover[s : s + 200] = True
        left[i] = len(before[i]) - int(cover.sum())
    assert set(after) == set(before) and all(left[i] <= len(after[i]) <= left[i] + 6 * len(re.findall(b"[\xc0-\xff]", before[i])) and (left[i] < len(before[i])) >= (after[i] != before[i]) for i in before)
    assert all(len(after[i]) == left[i] for i in before if before[i].isascii())

    fourth = stages["surrogates"](spark, third, SF).cache()
    assert fourth.columns == docs.columns and fourth.count() == third.count()
    last = stages["packing"](spark, fourth, SF).toPandas()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    total = sum(len([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, END_ID]) for r in fourth.collect())
    assert last.length.sum() == total and last.groupby("sequence_id").length.sum().max() <= 4096
