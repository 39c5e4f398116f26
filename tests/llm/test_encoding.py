"""Encoders against their libraries, on texts with special strings, odd white space and long pieces."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from quire.llm import encoding
from quire.llm.queries import BYTE_RANKS, WORD_BPE

SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>b", "x <|StartOfText|> y", "<|endoftext|> <|endoftext|>"]


def texts(n, seed):
    rng = random.Random(seed)
    bits = ["the", "Word", "don't", "İ", "ß", "é", "12345", ",", "...", "\n\n", "  ", "\t", "　", "\x01", "\x85", "漢字", "\U0001f600", "x" * 300, "-", "_", "!"]
    return ["".join(rng.choice([*bits, *SPECIAL] if i % 3 == 0 else bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for i in range(n)]


def parts(ids, bounds):
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_word_ids_are_those_of_the_plain_call():
    rows, plain = texts(1500, 1) + SPECIAL + [""], Tokenizer.from_file(WORD_BPE)
    encoder = encoding.word_encoder(WORD_BPE)
    got = parts(*encoding.encode_words(encoder, pa.array(rows, pa.large_string())))
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in rows]


def test_byte_ids_are_those_of_the_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = texts(1500, 2) + ["<|cut|> and <|cut|>", ""]
    got = parts(*encoding.encode_ranked(encoding.rank_encoder(BYTE_RANKS, P.PATTERN), pa.array(rows, pa.large_string())))
    assert got == [library.encode_ordinary(t) for t in rows]


def test_what_is_kept_has_a_bound(monkeypatch):
    """Texts with adjoining white space are pieces of their own and are not kept; short words are, up to the bound."""
    pool = encoding.rank_encoder.__wrapped__(BYTE_RANKS, P.PATTERN)
    monkeypatch.setattr(encoding, "CACHED_BYTES", 100_000)
    for k in range(50):
        rows = [f"paragraph {k} {i}\n\n" + "some words of it " * 40 for i in range(20)] + [f"w{k}x{i}" for i in range(200)]
        ids, bounds = encoding.encode_ranked(pool, pa.array(rows, pa.large_string()))
        assert len(bounds) == 221 and pool.bytes < 200_000 and len(pool.ids) < 1 << 21
        assert not any(len(w) > encoding.CACHED_WORD for w in pool.slot)
    assert np.array_equal(*(encoding.encode_ranked(p, pa.array(rows, pa.large_string()))[0] for p in (pool, encoding.rank_encoder(BYTE_RANKS, P.PATTERN))))
