"""Fingerprints by Spark's functions alone, with and without samples that are made once, against the plain sampler."""

import numpy as np

from quire.llm import fingerprints


def test_samples_are_those_of_the_plain_sampler_and_no_python_runs(spark):
    texts = spark.createDataFrame([(1, "a b b c c c Word word rare"), (2, "a"), (3, "a b b c c c"), (4, "x y z " * 40)], "k int, text string")
    known = fingerprints.known_samples(texts, 16)
    assert known.count() > 0
    found = fingerprints.signatures(texts, ["k"], "text", 16, known)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    sigs = {r.k: r.sig for r in found.collect()}
    assert sigs == {r.k: r.sig for r in fingerprints.signatures(texts, ["k"], "text", 16).collect()}
    for k, rows in fingerprints.counted(texts, ["k"], "text").toPandas().groupby("k"):
        terms, counts = rows["term"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
        assert sigs[k] == fingerprints._least(terms, counts, np.zeros(1, np.int64), 16)[0].tolist()
