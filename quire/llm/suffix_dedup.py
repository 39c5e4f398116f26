"""Exact repeated passages: byte strings of a fixed length that occur more than once anywhere in a table.

The suffix order is cut to prefixes of `length` bytes. Suffixes with equal prefixes are a run of that order whose least
position is the first copy: a suffix has a longest previous factor of at least `length` bytes just when a smaller position
lies in its run. So previous and next smaller positions reduce to a run's count and least position, which Spark
aggregates before it shuffles; a run of any size never meets in one task.

Sorting a suffix at every byte would multiply the text by `length`, so suffixes are grouped first. Every window of `length`
bytes belongs to the leftmost least hash of its short grams (its anchor), which depends on the window alone. Equal
windows have equal anchors; windows whose anchor is unique cannot repeat and are gone after one aggregate. Where whole
regions (all windows of one anchor) are equal, all of them repeat; only the edges of passages are looked at window by window.

Null texts count as empty. Texts shorter than the window have no suffixes. Rows that repeat doc_id and text are copies
of each other and are told apart by their number. An empty table gives an empty result. Columns beside doc_id and text
are not read; `without_later_copies` passes them through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import gather, slices
from .common import dropped, freed, written
from .shingles import mixed

GRAM = 48
#: Windows that are looked at together, by the bytes that all of them hold.
STEP = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


#: Windows that are looked at in one go, and the low bits of an anchor's rank that hold its place.
SPAN, PLACE_BITS = 1 << 21, 24


def regions(data: bytes, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor hash and anchor place of every run of windows with one anchor.

    data may hold several texts one after the other; windows over their joints are regions like others. Very long data is
    looked at in spans, and a region may then be cut in two.
    """
    n = len(data) - length + 1
    found = [_regions(memoryview(data)[a : min(a + SPAN, n) + length - 1], length, gram, a) for a in range(0, n, SPAN)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _regions(data, length: int, gram: int, base: int) -> tuple[np.ndarray, ...]:
    n = len(data) - length + 1
    codes = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(data) - gram + 1, np.uint64)
    # Grams by doubling: a hash of 2k bytes joins two hashes of k bytes.
    block, size, at = mixed(codes * _BASE), 1, 0
    rest = gram
    while rest:
        if rest & 1:
            h = mixed(h * np.uint64(31) + block[at : at + len(h)])
            at += size
        rest >>= 1
        if rest:
            block = mixed(block[: len(block) - size] * np.uint64(131) + block[size:])
            size *= 2
    # Sliding least rank over length - gram + 1 grams, by doubling: the high bits of the hash, then the place, so that the leftmost of equal ones wins.
    bits = np.uint64(PLACE_BITS)
    width, low, span = length - gram + 1, (h >> bits << bits) | np.arange(len(h), dtype=np.uint64), 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span : width - span + n])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    place = (low[first] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    return first + base, np.diff(first, append=n), h[place], place + base


def text_regions(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Text number, first window, windows, anchor hash and anchor place (in the text) of the regions of several texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    s, n, h, p = regions(b"".join(texts), length)
    owner = np.searchsorted(ends, s, "right")
    # A region may go on over a joint, so its windows are given to the texts they start in, less those that end in the next.
    extra = np.searchsorted(ends, s + n - 1, "right") - owner
    row = np.repeat(np.arange(len(s)), extra + 1)
    text = owner[row] + np.arange(len(row)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
    start = np.maximum(s[row], (ends - sizes)[text])
    stop = np.minimum((s + n)[row], ends[text] - length + 1)
    keep = stop > start
    text, start, stop, row = text[keep], start[keep], stop[keep], row[keep]
    begin = (ends - sizes)[text]
    return text, start - begin, stop - start, h[row], p[row] - begin


def _digest(data) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _marks(rows: DataFrame, length: int) -> DataFrame:
    """uid, h (anchor), r (hash of the region's bytes), s (first window), n (windows), p (anchor's place) of every region."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "data", 2 << 20):
                data = part.column("data").to_pylist()
                views = list(map(memoryview, data))
                t, s, n, h, p = text_regions(data, length)
                digests = (_digest(views[i][a : a + k - 1 + length]) for i, a, k in zip(t.tolist(), s.tolist(), n.tolist(), strict=True))
                out = [part.column("uid").to_numpy()[t], h.view(np.int64), np.fromiter(digests, np.int64, len(t)), s, n.astype(np.int32), (p - s).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), ["uid", "h", "r", "s", "n", "p"])

    return rows.select("uid", "data").mapInArrow(run, "uid long, h long, r long, s long, n int, p int")


def blocks(s: int, n: int, p: int, length: int, step: int = STEP):
    """(first window, windows, core from, core to): the windows of a region cut at multiples of step before its anchor.

    All windows of such a block hold the block's core, and equal windows of two regions lie in blocks with equal cores.
    """
    k = s
    while k < s + n:
        number = (p - k) // step
        past = min(s + n, p - number * step + 1)
        yield k, past - k, p - number * step, p - (number + 1) * step + 1 + length
        k = past


def repeats(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """uid, spans (array of from and to, sorted, maximal) of the bytes covered by repeated windows.

    rows has uid (unique) and data (binary). With keep_first, windows count only where an equal one lies at a smaller (uid, position).
    """
    spark = rows.sparkSession
    marks = written(_marks(rows, length), "regions")
    place = F.struct("uid", "s")
    # Written apart from the join, so that Spark can split the rows of a hot anchor over tasks.
    shared = written(marks.groupBy("h").agg(F.count("*").alias("all")).where(F.col("all") > 1).select("h"), "repeated-anchors")
    near = written(marks.join(shared, "h"), "shared-anchors")
    dropped(spark, marks, shared)
    same = written(near.groupBy("h", "r").agg(F.count("*").alias("copies"), F.min(place).alias("first")), "equal-regions")
    kinds = same.groupBy("h").agg(F.count("*").alias("kinds"))
    known = written(same.join(kinds, "h"), "known-regions")
    found = written(near.join(known, ["h", "r"]).select("uid", "s", "n", "p", "copies", "kinds", (place == F.col("first")).alias("is_first")), "shared-regions")
    dropped(spark, near, same, known)
    whole = found.where("copies > 1 and not is_first") if keep_first else found.where("copies > 1")
    # One of each kind of region is looked at, block by block, against the other kinds of its anchor.
    look = found.where("kinds > 1 and (copies = 1 or is_first)")
    todo = look.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("s", "n", "p"))).alias("look"))

    def cores(batches):
        for batch in batches:
            for part in slices(batch, "data"):
                out = []
                for uid, data, runs in zip(part.column("uid").to_pylist(), part.column("data").to_pylist(), part.column("look").to_pylist(), strict=True):
                    view = memoryview(data)
                    for run in runs:
                        place = run["s"] + run["p"]
                        out += [(uid, k, m, _digest(bytes(((place - a) & 255, (place - a) >> 8 & 255)) + bytes(view[a:b]))) for k, m, a, b in blocks(run["s"], run["n"], place, length)]
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], ["uid", "s", "n", "core"])

    cored = written(rows.join(todo, "uid").select("uid", "data", "look").mapInArrow(cores, "uid long, s long, n int, core long"), "block-cores")
    freed(spark)
    twice = cored.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core")
    todo = cored.join(twice, "core").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("look"))

    def table(starts, digests, uids):
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(uids), np.concatenate(starts), both[:, 0].copy(), both[:, 1].copy())], ["uid", "s", "w1", "w2"])

    def windows(batches):
        hashed = xxhash.xxh3_128_digest
        for batch in batches:
            for part in slices(batch, "data"):
                starts, digests, uids = [], [], []
                for uid, data, runs in zip(part.column("uid").to_pylist(), part.column("data").to_pylist(), part.column("look").to_pylist(), strict=True):
                    view = memoryview(data)
                    own = gather(*np.array([(run["s"], run["n"]) for run in runs], np.int64).T)
                    digests += [hashed(view[s : s + length]) for s in own.tolist()]
                    starts.append(own)
                    uids.append(np.full(len(own), uid, np.int64))
                    if len(digests) > 400_000:
                        yield table(starts, digests, uids)
                        starts, digests, uids = [], [], []
                if digests:
                    yield table(starts, digests, uids)

    looked = written(rows.join(todo, "uid").select("uid", "data", "look").mapInArrow(windows, "uid long, s long, w1 long, w2 long"), "edge-windows")
    dropped(spark, cored)
    least = [F.min(place).alias("first")] if keep_first else []
    # Written apart from the join, so that the shuffle of all windows is gone before they are shuffled again.
    runs = written(looked.groupBy("w1", "w2").agg(F.count("*").alias("copies"), *least).where("copies > 1").drop("copies"), "repeated-windows")
    freed(spark)
    again = looked.join(runs, ["w1", "w2"])
    if keep_first:
        again = again.where(place != F.col("first"))
    spans = whole.select("uid", F.col("s").alias("a"), (F.col("s") + F.col("n") - 1 + length).alias("b")).union(again.select("uid", F.col("s").alias("a"), (F.col("s") + length).alias("b")))
    out = written(spans.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans")), "spans")
    dropped(spark, found, looked, runs)
    return out


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for span in spans or ():
        if out and span["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], span["b"])
        else:
            out.append([span["a"], span["b"]])
    return out


def removed(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: every byte that a repeated window covers goes, first copies too.

    Rows that share doc_id and text have equal results, so they are one row with a count until the end.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data")).withColumn("uid", F.xxhash64("doc_id", "data"))
    spans = repeats(base, length, keep_first=False)

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "data"):
                rows = []
                for doc_id, data, found in zip(part.column("doc_id").to_pylist(), part.column("data").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    merged = _merged(found)
                    kept, at = hashlib.sha256(), 0
                    for a, b in merged:
                        kept.update(data[at:a])
                        at = b
                    kept.update(data[at:])
                    rows.append((doc_id, len(data), sum(b - a for a, b in merged), len(merged), kept.hexdigest()))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return base.join(spans, "uid", "left").select("doc_id", "data", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _in_order(docs: DataFrame) -> DataFrame:
    """row (all columns) and uid, which is unique and grows with doc_id, hash and a number that tells equal rows apart.

    The ids count on through sorted ranges; they are written at once, as another run may cut the ranges elsewhere.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(docs.doc_id, docs.text).alias("hash"), F.monotonically_increasing_id().alias("number"))
    order = [F.col("row.doc_id").asc_nulls_last(), F.col("hash").asc(), F.col("number").asc()]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranges.select("row", F.monotonically_increasing_id().alias("uid")), "ordered-rows")


def without_later_copies(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with the text of every later copy taken out and the first copy kept; a character that a cut would split stays whole.

    Order is by (doc_id with nulls last, hash, number within equal rows, position), so the smallest doc_id keeps the passage.
    Rows whose text is null stay as they are; n_chars, where present, follows the new text.
    """
    fields = docs.columns
    table = _in_order(docs).select("row", F.coalesce("row.text", F.lit("")).cast("binary").alias("data"), "uid")
    spans = repeats(table.select("uid", "data"), length, keep_first=True)
    joined = table.join(spans, "uid", "left")

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "data"):
                texts = []
                for data, found in zip(part.column("data").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    at, kept = 0, []
                    for a, b in _merged(found):
                        while a < b and data[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                            b -= 1
                        kept.append(data[at:a])
                        at = max(at, b)
                    kept.append(data[at:])
                    texts.append(b"".join(kept).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], ["row", "cut_text"])

    schema = T.StructType([T.StructField("row", joined.schema["row"].dataType), T.StructField("cut_text", T.StringType())])
    out = joined.select("row", "data", "spans").mapInArrow(cut, schema)
    columns = []
    for name in fields:
        old = F.col("row").getField(name)
        if name == "text":
            old = F.when(old.isNotNull(), F.col("cut_text"))
        elif name == "n_chars":
            old = F.when(F.col("row").getField("text").isNotNull(), F.length("cut_text").cast(docs.schema[name].dataType)).otherwise(old)
        columns.append(old.alias(name))
    return out.select(*columns)
