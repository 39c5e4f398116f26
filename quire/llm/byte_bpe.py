"""Byte-level BPE by a rank file: ids of whole texts, and bytes and texts from ids.

Null texts count as empty and have no ids. Ids that split a character decode to parts of its bytes; as text, such
bytes become U+FFFD only where the whole sequence of ids leaves them unfinished. Rows stay as they are, repeated ones
too; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import gather, slices, texts
from .encoding import encode_ranked, rank_encoder, rank_tokenizer


class ByteTable:
    """The bytes of all tokens one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all texts, and the bounds of each."""
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[gather(self.starts[ids], lengths)].tobytes(), ends[bounds]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offsets of the tokens in the decoded bytes, and their end."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, offsets array<int>: the ids of each whole text and the byte where each token starts."""

    def run(batches):
        pool, table = rank_encoder(ranks, pattern), ByteTable(rank_tokenizer(ranks, pattern)[1])
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = encode_ranked(pool, texts(part))
                starts = table.offsets(ids)
                offsets = starts[:-1] - np.repeat(starts[bounds[:-1]], np.diff(bounds))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (ids, offsets)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], ["doc_id", "ids", "offsets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, bytes, text: the bytes of ids (null ids: none), and as text."""

    def run(batches):
        table = ByteTable(rank_tokenizer(ranks, pattern)[1])
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            data, bounds = table.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]))
            parts = [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(parts, pa.binary()), pa.array([p.decode("utf-8", "replace") for p in parts], pa.string())], ["doc_id", "bytes", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary, text string")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes that the ids decode to): one pass, without a shuffle."""

    def run(batches):
        pool, tokens = rank_encoder(ranks, pattern), rank_tokenizer(ranks, pattern)[1]
        table, names = ByteTable(tokens), [str(i) for i in range(len(tokens))]
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = encode_ranked(pool, texts(part))
                data, ends = table.decode(ids, bounds)
                named = list(map(names.__getitem__, ids.tolist()))
                rows = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array([hashlib.sha256(",".join(named[a:b]).encode()).hexdigest() for a, b, _, _ in rows]), pa.array([hashlib.sha256(data[c:d]).hexdigest() for _, _, c, d in rows])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
