"""Samples of words: a text's do not depend on its neighbours, and their collisions are the generalised Jaccard similarity."""

import numpy as np

from quire.llm import fingerprints


def test_a_text_has_its_samples_wherever_it_lies(monkeypatch):
    rng = np.random.default_rng(1)
    sizes = [1, 5, 300, 1, 40, 7]
    terms = rng.integers(0, 60, sum(sizes)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = rng.integers(1, 9, sum(sizes))
    starts = np.append(0, np.cumsum(sizes)[:-1])
    alone = [fingerprints._least(terms[a : a + n], counts[a : a + n], np.zeros(1, np.int64), 16)[0].tolist() for a, n in zip(starts, sizes)]
    plain = [(fingerprints._values(terms[a : a + n], counts[a : a + n], 16).min(0) & 0xFFFFF).tolist() for a, n in zip(starts, sizes)]
    for block in (3, 64, 1 << 16):
        monkeypatch.setattr(fingerprints, "_ROWS", block)
        assert fingerprints._least(terms, counts, starts, 16).tolist() == alone == plain


def test_collisions_are_the_generalised_jaccard_similarity():
    terms = np.arange(1, 101).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = np.where(np.arange(100) < 50, 4, 1), np.where(np.arange(100) < 50, 2, 3)
    one, two = (fingerprints._least(terms, w, np.zeros(1, np.int64), 20_000)[0] for w in (a, b))
    assert abs((one == two).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02
