"""Exact top-k search over binary codes by multi-index hashing with growing segment radii.

A code of 64 bits is cut into m segments, of at most as many bits as the number of codes has, so that a value has a code or
more and few values without a code are probed. At radius r a query probes
every segment value at Hamming distance r from its own; after that all codes nearer than m (r + 1) are found. A query is
done when its k-th verified distance is below that, and only the others go on, with that distance as the bound of all
they still look for and of how many segments the last radius takes. Where a radius has more values to probe than a share of all codes, the queries that are left are
compared with all codes, in blocks of queries. No bucket or radius is capped. Rows with equal codes are one class, whose k
smallest ids are all that a top-k can need; of classes at one distance those with the smallest ids are.

Null or empty embeddings, and null ids, are left out. Ties go to the smaller id; rows that share an id and code count
once. An empty table gives an empty result. Columns beside the id and the embedding are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, partitions, written

#: Probes of one query, as a share of all codes, beyond which comparing all codes is less work; queries of a block.
PROBE_SHARE, BLOCK = 1 / 4, 50_000


def codes(table: DataFrame, id_column: str, vector: str, seed: int = 7) -> DataFrame:
    """id and code (64 signs of fixed random projections) of every row with a vector."""

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            sizes = np.asarray(lists.value_lengths())
            flat = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            ends = np.cumsum(sizes)
            out = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
                planes = np.random.default_rng(seed).standard_normal((int(dim), 64))
                out[rows] = np.packbits((x @ planes) > 0, axis=1).view(np.int64)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out)], ["id", "code"])

    known = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
    return known.mapInArrow(run, "id long, code long")


def segments_for(n: int) -> list[tuple[int, int]]:
    """First bit and width of each segment of 64 bits, for n codes."""
    m = min(8, max(2, math.ceil(64 / math.log2(n + 2))))
    cuts = [64 * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _parts(code: str, segments: list[tuple[int, int]]):
    return F.explode(F.array(*(F.struct(F.lit(k).alias("segment"), F.shiftrightunsigned(F.col(code), a).bitwiseAND(F.lit((1 << w) - 1)).alias("value")) for k, (a, w) in enumerate(segments))))


def _masks(segments: list[tuple[int, int]], radius: int):
    """All values of a segment's width with radius bits set, by the segment; as text, which Spark makes a constant of."""
    out = None
    for k, (_, w) in enumerate(segments):
        values = F.split(F.lit(",".join(str(sum(1 << b for b in bits)) for bits in combinations(range(w), radius))), ",").cast("array<bigint>")
        out = F.when(F.col("x.segment") == k, values) if out is None else out.when(F.col("x.segment") == k, values)
    return out


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _nearest(found: DataFrame, want: int) -> DataFrame:
    """Of each query the want nearest classes (query, code, n, first_id, distance), by distance and smallest id."""
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "first_id"))
    return found.withColumn("place", place).where(F.col("place") <= want).drop("place")


def _bounds(active: DataFrame, found: DataFrame, want: int) -> DataFrame:
    """query, bound: the distance within which want rows are known, 64 where fewer are."""
    running = F.sum("n").over(Window.partitionBy("query").orderBy("distance", "first_id"))
    known = found.withColumn("sofar", running).where(F.col("sofar") >= want).groupBy("query").agg(F.min("distance").alias("bound"))
    return active.select("query").join(known, "query", "left").select("query", F.coalesce("bound", F.lit(64)).alias("bound"))


def _compared(classes: DataFrame, active: DataFrame, want: int) -> DataFrame | None:
    """The nearest classes of the active queries among all classes; a block of queries at a time comes to the driver."""
    out = None
    for k in range(0, active.count(), BLOCK):
        block = active.orderBy("query").offset(k).limit(BLOCK).toPandas()
        codes, bounds = block["query"].to_numpy(), block["bound"].to_numpy()

        def run(batches, codes=codes, bounds=bounds):
            for batch in batches:
                own, ids, n = (batch.column(c).to_numpy() for c in ("code", "first_id", "n"))
                rows = [[], [], []]
                for query, bound in zip(codes, bounds, strict=True):
                    distance = np.bitwise_count((own ^ query).view(np.uint64))
                    near = np.flatnonzero(distance <= bound)
                    if len(near) > want:
                        near = near[np.lexsort((ids[near], distance[near]))[:want]]
                    rows[0].append(np.full(len(near), query)), rows[1].append(near), rows[2].append(distance[near].astype(np.int32))
                query, near, distance = map(np.concatenate, rows)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query, own[near], n[near], ids[near], distance)], ["query", "code", "n", "first_id", "distance"])

        part = classes.select("code", "n", "first_id").mapInArrow(run, "query long, code long, n int, first_id long, distance int")
        out = part if out is None else out.union(part)
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), id, distance: the k nearest rows of every query, itself left out.

    rows and queries have id and code.
    """
    spark = rows.sparkSession
    want = k + 1  # the query itself may be among the rows
    place = F.row_number().over(Window.partitionBy("code", "part").orderBy("id"))
    distinct = rows.distinct()
    # The smallest ids of a class, first within parts of it, so that no task holds a whole class.
    few = distinct.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(partitions(spark)))).withColumn("n", place).where(F.col("n") <= want).groupBy("code").agg(F.slice(F.array_sort(F.collect_list("id")), 1, want).alias("ids"))
    classes = written(few.select("code", "ids", F.size("ids").alias("n"), F.get("ids", 0).alias("first_id")), "code-classes")
    total = classes.count()
    segments = segments_for(total)
    index = written(classes.select("code", "n", "first_id", _parts("code", segments).alias("x")).select("code", "n", "first_id", "x.segment", "x.value"), "segment-index")
    active = written(queries.select(F.col("code").alias("query"), F.lit(64).alias("bound")).distinct(), "query-codes")
    done, found = None, None
    for radius in range(65):
        probing = radius <= max(w for _, w in segments) and sum(math.comb(w, radius) for _, w in segments) <= max(total * PROBE_SHARE, 8)
        if probing:
            # All within the bound have a segment at a smaller radius, or one of the first bound + 1 - m radius segments at this one.
            needed = F.col("x.segment") < F.col("bound") + 1 - len(segments) * radius
            probes = active.select("query", "bound", _parts("query", segments).alias("x")).where(needed).select("query", "bound", "x.segment", F.col("x.value").alias("own"), F.explode(_masks(segments, radius)).alias("mask"))
            probes = probes.select("query", "bound", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
            near = probes.join(index, ["segment", "value"]).where(_distance("query", "code") <= F.col("bound")).select("query", "code", "n", "first_id", _distance("query", "code").alias("distance"))
            near = near if found is None else near.union(found.join(active.select("query"), "query", "left_semi"))
            covered = len(segments) * (radius + 1) - 1
        else:
            near, covered = _compared(classes, active, want), 64
        if near is None:
            break
        found = written(_nearest(near.distinct(), want), "candidates")
        bounds = written(_bounds(active, found, want), "query-bounds")
        proven = bounds.where(F.col("bound") <= covered)
        part = found.join(proven.select("query"), "query", "left_semi")
        done = part if done is None else done.union(part)
        active = written(bounds.where(F.col("bound") > covered), "active")
        if not probing or active.isEmpty():
            break
    dropped(spark, index)
    if done is None:
        done = spark.createDataFrame([], "query long, code long, n int, first_id long, distance int")
    pairs = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct().join(done, "query").join(classes.select("code", F.explode("ids").alias("id")), "code").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", F.col("distance").cast("int").alias("distance"))
