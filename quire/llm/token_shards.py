"""Token-id shards: binary files of documents' token ids, each document compressed alone with one shared zstandard dictionary.

A shard is: the magic, a JSON header with the dictionary's hash, one zstandard frame for each document in
ascending doc_id order, an index (doc_id, its null flag, frame offset, ids before the document), and a footer.
The index gives any single document with three short reads.

Null texts count as empty, so a document has at least its end id. Null doc_ids come first. Rows that share a doc_id
stay apart, in the order of their texts. An empty table gives no shards. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow import slices, texts
from .common import new_path, partitions
from .encoding import encode_words, with_end, word_encoder

MAGIC = b"QTOKENS1"
FOOTER = struct.Struct("<QQ8s")
MANIFEST = "shard int, file string, n_docs long, n_tokens long, first_doc_id long"


def file_system(uri: str):
    """The Arrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample_docs: int = 400, piece_ids: int = 2048, dictionary_bytes: int = 65536) -> bytes:
    """Trains the dictionary on the id arrays of the sample_docs documents with the smallest id hashes; empty where there is too little.

    Only the ratio depends on the sample, not what is stored. Long id arrays are cut into pieces; at most 4 MB of pieces are used.
    """
    import zstandard

    width = id_width(tokenizer)
    sample = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id").alias("h")).orderBy("h", F.xxhash64("text")).limit(sample_docs).select("text")

    def pieces(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = with_end(*encode_words(word_encoder(tokenizer), texts(part)), end_id)
                ids = ids.astype(width)
                rows = [ids[k : min(k + piece_ids, b)].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True) for k in range(a, b, piece_ids)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["piece"])

    found, total = [], 0
    for row in sample.mapInArrow(pieces, "piece binary").limit(sample_docs * 8).collect():
        if total < 4 << 20:
            found.append(bytes(row.piece))
            total += len(row.piece)
    try:
        return zstandard.train_dictionary(min(dictionary_bytes, max(1024, total // 8)), found).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def id_width(tokenizer: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 65536 else "<u4"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, uri: str, shards: int | None = None, level: int = 3) -> DataFrame:
    """Encodes every text, appends end_id and writes the shards under uri; returns the manifest, a row for each shard.

    docs is dealt out by ranges of doc_id. A task writes beside its shard and renames at the end, so a task that
    runs again replaces the same file by the same bytes.
    """
    spark = docs.sparkSession
    dictionary, width = train_dictionary(docs, tokenizer, end_id), id_width(tokenizer)
    files, root = file_system(uri)
    files.create_dir(root)
    with files.open_output_stream(f"{root}/dictionary") as out:
        out.write(dictionary)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = dealt.mapInArrow(lambda batches: _write_shard(batches, tokenizer, end_id, uri, dictionary, width, level), MANIFEST)
    manifest.write.parquet(f"{uri}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")


def _compressor(dictionary: bytes, level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _write_shard(batches, tokenizer: str, end_id: int, uri: str, dictionary: bytes, width: str, level: int):
    files, root = file_system(uri)
    context = TaskContext.get()
    name = f"shard-{context.partitionId():07d}"
    spare = f"{root}/.{name}-{context.taskAttemptId()}"
    compress = _compressor(dictionary, level).compress
    header = json.dumps({"dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "width": width, "end_id": end_id}).encode()
    doc_ids, nulls, ends, counts = [], [], [], []
    out = None
    for batch in batches:
        for part in slices(batch, "text"):
            ids, bounds = with_end(*encode_words(word_encoder(tokenizer), texts(part)), end_id)
            if out is None:
                out = files.open_output_stream(spare)
                out.write(MAGIC + struct.pack("<I", len(header)) + header)
                at = len(MAGIC) + 4 + len(header)
            data, size = memoryview(ids.astype(width).tobytes()), int(width[-1])
            frames = [compress(data[a:b]) for a, b in zip(bounds[:-1] * size, bounds[1:] * size, strict=True)]
            out.write(b"".join(frames))
            column = part.column("doc_id")
            doc_ids.append(column.fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(column.is_null().to_numpy(zero_copy_only=False))
            lengths = np.fromiter(map(len, frames), np.int64, len(frames))
            ends.append(at + np.cumsum(lengths))
            at += int(lengths.sum())
            counts.append(np.diff(bounds))
    if out is None:
        return
    doc_ids, nulls, ends, counts = map(np.concatenate, (doc_ids, nulls, ends, counts))
    starts = np.concatenate([[len(MAGIC) + 4 + len(header)], ends]).astype("<i8")
    before = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
    out.write(doc_ids.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + starts.tobytes() + before.tobytes())
    out.write(FOOTER.pack(at, len(doc_ids), MAGIC))
    out.close()
    files.move(spare, f"{root}/{name}")
    first = None if nulls[0] else int(doc_ids[0])
    yield pa.RecordBatch.from_pylist([{"shard": context.partitionId(), "file": name, "n_docs": len(doc_ids), "n_tokens": int(before[-1]), "first_doc_id": first}], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_doc_id", pa.int64())]))


class Shard:
    """An open shard: its index, and any document's ids."""

    def __init__(self, uri: str, name: str):
        import zstandard

        files, root = file_system(uri)
        self.file = files.open_input_file(f"{root}/{name}")
        size = self.file.size()
        at, n, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        start, length = self.file.read_at(len(MAGIC), 0), struct.unpack("<I", self.file.read_at(4, len(MAGIC)))[0]
        if magic != MAGIC or start != MAGIC:
            raise ValueError(f"{name} is no token shard")
        header = json.loads(self.file.read_at(length, len(MAGIC) + 4))
        with files.open_input_stream(f"{root}/dictionary") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != header["dictionary_sha256"]:
            raise ValueError(f"{name} was written with another dictionary")
        self.width, self.end_id = header["width"], header["end_id"]
        index = self.file.read_at(size - FOOTER.size - at, at)
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.nulls = np.frombuffer(index, "u1", n, 8 * n).astype(bool)
        self.starts = np.frombuffer(index, "<i8", n + 1, 9 * n)
        self.before = np.frombuffer(index, "<i8", n + 1, 17 * n + 8)
        self._decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def frames(self, first: int, last: int) -> list[np.ndarray]:
        """Ids of the documents first to last - 1, by one read."""
        a = int(self.starts[first])
        data = memoryview(self.file.read_at(int(self.starts[last]) - a, a))
        return [np.frombuffer(self._decompress(data[self.starts[i] - a : self.starts[i + 1] - a]), self.width) for i in range(first, last)]

    def document(self, doc_id: int) -> np.ndarray | None:
        """Ids of the first row with doc_id."""
        known = self.doc_ids[np.count_nonzero(self.nulls) :]
        i = int(np.searchsorted(known, doc_id))
        if i == len(known) or known[i] != doc_id:
            return None
        i += len(self.doc_ids) - len(known)
        return self.frames(i, i + 1)[0]


def read_shards(spark: SparkSession, uri: str, manifest: DataFrame, ids: bool = True) -> DataFrame:
    """Reads all shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids.

    The manifest has a row for each shard, so its running sum is short.
    """
    running = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", "shard", F.coalesce(F.sum("n_tokens").over(running), F.lit(0)).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(uri, row["file"])
                for k in range(0, len(shard.doc_ids), 2000):
                    end = min(k + 2000, len(shard.doc_ids))
                    found = shard.frames(k, end)
                    columns = [pa.array(shard.doc_ids[k:end], pa.int64(), mask=shard.nulls[k:end]), pa.array(row["base"] + shard.before[k:end]), pa.array(np.diff(shard.before[k : end + 1])), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if ids:
                        columns.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return placed.repartition(partitions(spark)).mapInArrow(read, schema)


def token_shards(docs: DataFrame, tokenizer: str, end_id: int, uri: str | None = None) -> DataFrame:
    """Writes docs as shards and reads them back: doc_id, start, n_tokens, ids_crc32."""
    uri = uri or new_path(docs.sparkSession, "token-shards")
    return read_shards(docs.sparkSession, uri, write_shards(docs, tokenizer, end_id, uri), ids=False)
