"""Sets of word shingles as 64-bit hashes, for Arrow batches inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(text: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, in one array, and n + 1 bounds.

    Lower-cases A-Z; words lie between spaces and the controls from tab to carriage return. A text with fewer words is one
    shingle of all of them, one without words has none.
    """
    spaced = pc.ascii_trim(pc.replace_substring_regex(pc.ascii_lower(text), "[\\x20\\x09-\\x0D]+", " "), " ")
    parts = pc.split_pattern(spaced, " ")
    bounds = parts.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    counts = np.diff(bounds) * (pc.binary_length(spaced).to_numpy(zero_copy_only=False) > 0)
    coded = parts.flatten().dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    h = mixed(known[codes]) if len(codes) else np.zeros(0, np.uint64)
    n = len(counts)
    taken = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(n), taken)
    first = np.repeat(bounds[:-1], taken) + np.arange(len(owner)) - np.repeat(np.cumsum(taken) - taken, taken)
    last = np.repeat(bounds[:-1] + counts, taken)
    out = np.full(len(owner), np.uint64(words))
    for k in range(words):
        inside = first + k < last
        out = np.where(inside, mixed(out * _ODD + h[np.minimum(first + k, len(h) - 1)]) if len(h) else out, out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=n))])
