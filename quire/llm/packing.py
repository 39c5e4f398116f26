"""Packing of token sequences by cutting-stock column generation.

A document is cut into whole sequences and a rest. The histogram of rest lengths, in classes of `unit` tokens rounded up,
has a fixed number of rows at any input size; only it comes to the driver. A linear program over patterns (how many
pieces of each class share a sequence) is solved by column generation, a knapsack over the classes prices new patterns,
and the rounded-down solution plus patterns for what is left cover every piece. Pieces are ranked within their class,
and a rank tells the pattern and the copy of it that the piece goes to.

Null texts count as empty and have the end id only. Null doc_ids and repeated rows are packed like others. An empty
table gives an empty result. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow import slices, texts
from .common import partitions, ranked, written
from .encoding import encode_words, with_end, word_encoder

UNIT = 16


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: cuts of capacity tokens and a rest for every document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = with_end(*encode_words(word_encoder(tokenizer), texts(part)), end_id)
                ids = ids.astype("<u4")
                rows = [(i, a, min(capacity, n - a), n, base) for i, (base, n) in enumerate(zip(bounds[:-1].tolist(), np.diff(bounds).tolist(), strict=True)) for a in range(0, n, capacity)]
                owner, start, length, total, base = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                crc = [zlib.crc32(ids[b + a : b + a + k].tobytes()) for a, k, b in zip(start.tolist(), length.tolist(), base.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value that fits in room: unbounded knapsack by dynamic programming."""
    gain, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        gain[c] = gain[c - 1]
        fit = np.flatnonzero(sizes <= c)
        if len(fit):
            offers = gain[c - sizes[fit]] + values[fit]
            k = int(np.argmax(offers))
            if offers[k] > gain[c] + 1e-12:
                gain[c], pick[c] = offers[k], fit[k]
    out, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(gain[room]), out


def patterns_for(demand: dict[int, int], room: int, max_columns: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class size: pieces}, copies) that hold at least the demanded number of pieces of each class.

    Revised simplex: the basis starts with one pattern for each class, each pivot brings in the pattern with the best price.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ need
    for _ in range(max_columns):
        prices = inverse.sum(axis=0)
        gain, column = best_pattern(prices, sizes, room)
        if gain <= 1 + 1e-7:
            break
        direction = inverse @ column
        rows = np.flatnonzero(direction > 1e-9)
        if not len(rows):
            break
        leave = rows[np.argmin(x[rows] / direction[rows])]
        step = x[leave] / direction[leave]
        x -= step * direction
        x[leave] = step
        inverse[leave] /= direction[leave]
        others = np.arange(len(sizes)) != leave
        inverse[others] -= np.outer(direction[others], inverse[leave])
        basis[:, leave] = column
    copies = np.floor(np.maximum(x, 0) + 1e-6).astype(np.int64)
    out = [({int(sizes[i]): int(basis[i, j]) for i in np.flatnonzero(basis[:, j] > 0.5)}, int(copies[j])) for j in range(len(sizes)) if copies[j] > 0]
    left = np.maximum(need - basis @ copies, 0).round().astype(np.int64)
    # What rounding leaves is at most one pattern's pieces for each class: first fit, longest first.
    bins: list[tuple[int, dict[int, int]]] = []
    for i in range(len(sizes) - 1, -1, -1):
        size = int(sizes[i])
        for _ in range(int(left[i])):
            for k, (free, held) in enumerate(bins):
                if free >= size:
                    held[size] = held.get(size, 0) + 1
                    bins[k] = (free - size, held)
                    break
            else:
                bins.append((room - size, {size: 1}))
    return out + [(held, 1) for _, held in bins]


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (class, first rank, end rank, pieces per copy, first sequence): where the ranked pieces of a class go."""
    out, taken, sequence = [], {}, 0
    for held, copies in patterns:
        for size, pieces_each in held.items():
            first = taken.get(size, 0)
            taken[size] = first + pieces_each * copies
            out.append((size, first, taken[size], pieces_each, sequence))
        sequence += copies
    return out


def packed(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, unit: int = UNIT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset (gapless from 0) of every piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, end_id, capacity).withColumn("size", F.ceil(F.col("length") / unit).cast("int")), "pieces")
    demand = {r["size"]: r["count"] for r in cut.groupBy("size").count().collect()}  # at most capacity / unit rows
    rows = slots(patterns_for(demand, capacity // unit))
    # The table has at most (capacity / unit) squared rows, whatever the input.
    places = F.broadcast(spark.createDataFrame(rows, "p_size int, first long, past long, each long, sequence long"))
    numbered = ranked(cut, ["size"], ["doc_id", "start", "ids_crc32"], "rank", partitions(spark))
    placed = numbered.join(places, (F.col("size") == F.col("p_size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("each")))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
