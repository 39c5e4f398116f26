"""String kernels on batches that are cut into slices."""

import re

import numpy as np
import pyarrow as pa

from quire.llm import arrow, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_slices_give_the_words_of_their_own_rows():
    rng = np.random.default_rng(7)
    vocabulary = ["éaux", "The", "zu", "enschstie", "Übel", "x"]
    rows = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], ["doc_id", "text"])
    seen = 0
    for part in arrow.slices(batch, "text", 3000):
        text = arrow.texts(part)
        assert text.offset == 0
        _, bounds = shingles.shingle_sets(text)
        for i, row in enumerate(text.to_pylist()):
            words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), row))
            want = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
            assert row == rows[seen] and bounds[i + 1] - bounds[i] == len(want)
            seen += 1
    assert seen == len(rows)
