"""Whitening of embeddings by exact integer statistics.

Entries become integers, so the sums and products that tasks make of their rows are exact, whatever the order: each task
sends a row for each pair of dimensions, and Spark sums them. The scaled scatter matrix (one row and column for each
dimension, whatever the number of vectors) goes through its exact characteristic polynomial (charpoly.py): the residues by
primes and the vectors by components are tasks of their own.

Left out: rows whose vector is null, empty, or holds null or non-finite entries, and those whose vector has another length
than most (of lengths that are equally common, the longest). Null or repeated ids keep their rows. An integer entry is cut
to 62 bits. Components with an eigenvalue of zero come last and have null for whitened; without any positive eigenvalue
(one vector, or equal ones) identity_error and explained are null. deviation is null where it does not fit a long;
deviation_exact then has its digits. No usable row gives an empty result. Columns beside the two named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .charpoly import coefficient_bits, combined, eigenvectors, primes_for, residues, roots
from .common import partitions
from .vectors import finite, matrices

STEPS, SHIFT = 64, 1_000_000
_LIMB, _ROWS = 20, 4096
_FOUND = "vec_id long, deviation long, deviation_exact string, whitened array<double>"


def _usable(table: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, int]:
    """vec_id and v (doubles) of the rows that count, and the length of their vectors (0 without any)."""
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(finite(F.col("v")) & (F.size("v") > 0))
    lengths = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    size = lengths["length"] if lengths else 0
    return rows.where(F.size("v") == size), size


def _steps(entries: np.ndarray) -> np.ndarray:
    """floor(64 * entry) as integers of 62 bits; the shift by a constant does not change any covariance and is left out."""
    return np.clip(np.floor(entries * STEPS), -(2.0**62), 2.0**62).astype(np.int64)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as digits of 20 bits, the last one signed: products of 4096 rows then are exact in doubles."""
    out = []
    while len(x) and max(x.max(), -x.min()) >= 1 << _LIMB:
        out.append((x & ((1 << _LIMB) - 1)).astype(np.float64))
        x = x >> _LIMB
    return [*out, x.astype(np.float64)]


def _scatter(rows: DataFrame, size: int) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, sums of each dimension and of the products of each two, all exact."""

    def run(batches):
        n, sums, products = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            for _, entries in matrices(batch, "v"):
                for k in range(0, len(entries), _ROWS):
                    x = _steps(entries[k : k + _ROWS])
                    n += len(x)
                    limbs = _limbs(x)
                    for a, left in enumerate(limbs):
                        sums += left.sum(0).astype(np.int64).astype(object) << (_LIMB * a)
                        for b, right in enumerate(limbs):
                            products += (left.T @ right).astype(np.int64).astype(object) << (_LIMB * (a + b))
        upper = [(i, j) for i in range(size) for j in range(i, size)]
        values = [n, *sums, *(products[i, j] for i, j in upper)]
        first = [-1, *[-1] * size, *(i for i, _ in upper)]
        second = [-1, *range(size), *(j for _, j in upper)]
        parts = [[int(v) >> (32 * k) & 0xFFFFFFFF for v in values] for k in range(4)] + [[int(v) >> 128 for v in values]]
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), *(pa.array(p, pa.int64()) for p in parts)], ["i", "j", "p0", "p1", "p2", "p3", "p4"])

    parts = rows.select("v").mapInArrow(run, "i int, j int, p0 long, p1 long, p2 long, p3 long, p4 long")
    total = parts.groupBy("i", "j").agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(5))).collect()  # size * (size + 3) / 2 + 1 rows
    value = {(r["i"], r["j"]): sum(r[f"p{k}"] << (32 * k) for k in range(5)) for r in total}
    products = np.array([[value[min(i, j), max(i, j)] for j in range(size)] for i in range(size)], object)
    return value[-1, -1], [value[-1, j] for j in range(size)], products


def _polynomial(spark: SparkSession, matrix: np.ndarray, trace: int) -> list[int]:
    primes = primes_for(coefficient_bits(trace, len(matrix)))

    def run(batches):
        for batch in batches:
            mine = [primes[k] for k in batch.column("id").to_pylist()]
            for k in range(0, len(mine), 16):
                found = residues(matrix, mine[k : k + 16])
                yield pa.RecordBatch.from_arrays([pa.array(mine[k : k + 16], pa.int64()), pa.array(found.tolist(), pa.list_(pa.int64()))], ["prime", "residues"])

    tasks = min(partitions(spark), -(-len(primes) // 16))
    rows = spark.range(0, len(primes), 1, tasks).mapInArrow(run, "prime long, residues array<long>").collect()  # by the size of the matrix
    return combined([r["residues"] for r in rows], [r["prime"] for r in rows])


def _vectors(spark: SparkSession, matrix: np.ndarray, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Rows of eigenvectors in the order of found; those of one root are made in one task."""

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                rows = eigenvectors(matrix, *found[k])
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), pa.int64()), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["k", "v"])

    rows = spark.range(0, len(found), 1, min(len(found), partitions(spark))).mapInArrow(run, "k long, v array<double>").collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["k"])])


def whitened(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact of each usable row and component."""
    spark = table.sparkSession
    rows, size = _usable(table, id_column, vector)
    columns = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    if not size:
        return spark.createDataFrame([], columns)
    n, sums, products = _scatter(rows, size)
    outer = np.array(sums, object)
    matrix = n * products - outer[:, None] * outer[None, :]  # n * n times the covariance
    trace, want = int(np.trace(matrix)), min(components, size)
    found = roots(_polynomial(spark, matrix, trace), trace, want)
    values = [root / (1 << scale) for root, scale, many in found for _ in range(many)][:want]
    directions = _vectors(spark, matrix, found)[:want]
    positive = sum(v > 0 for v in values)
    scaled = (directions[:positive] / np.sqrt(np.array(values[:positive]))[:, None]).T

    def centred(entries: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where they hold it, else Python integers."""
        x = _steps(entries)
        if len(x) and (max(int(x.max()), -int(x.min())) * n + max(map(abs, sums))) < 1 << 62:
            return x * n - np.array(sums, np.int64)
        return x.astype(object) * n - outer

    def transform(batches):
        for batch in batches:
            for where, entries in matrices(batch, "v"):
                for k in range(0, len(entries), _ROWS):
                    y = centred(entries[k : k + _ROWS])
                    flat = y.astype(np.float64)
                    if (flat * flat).sum(1).max() >= 2.0**62:
                        exact = [sum(int(v) ** 2 for v in row) for row in y]
                    else:
                        exact = (y * y).sum(1).tolist()
                    small = [v if v < 1 << 63 else None for v in exact]
                    digits = [None if v < 1 << 63 else str(v) for v in exact]
                    z = np.full((len(y), want), np.nan)
                    z[:, :positive] = flat @ scaled
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * want, pa.int32()), pa.array(z.ravel(), from_pandas=True))
                    ids = batch.column("vec_id").take(pa.array(where[k : k + _ROWS]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(small, pa.int64()), pa.array(digits, pa.string()), lists], ["vec_id", "deviation", "deviation_exact", "whitened"])

    def moments(batches):
        total, squares = np.zeros(positive), np.zeros((positive, positive))
        for batch in batches:
            for _, entries in matrices(batch, "v"):
                for k in range(0, len(entries), _ROWS):
                    z = centred(entries[k : k + _ROWS]).astype(np.float64) @ scaled
                    total += z.sum(0)
                    squares += z.T @ z
        all_ = np.concatenate([total[None], squares])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(positive + 1), positive), pa.int64()), pa.array(np.tile(np.arange(positive), positive + 1), pa.int64()), pa.array(all_.ravel())], ["i", "j", "value"])

    error = None
    if positive:
        cells = rows.mapInArrow(moments, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()  # components * (components + 1) rows
        grid = np.zeros((positive + 1, positive))
        for r in cells:
            grid[r["i"], r["j"]] = r["value"]
        mean = grid[0] / n
        error = float(np.abs(grid[1:] / n - mean[:, None] * mean - np.eye(positive)).max())
    share = F.get(F.array(*(F.lit(float(v) / trace if trace else None).cast("double") for v in values)), F.col("component") - 1)
    each = rows.mapInArrow(transform, _FOUND).select("vec_id", "deviation", "deviation_exact", F.posexplode("whitened").alias("place", "whitened"))
    each = each.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", "deviation_exact")
    return each.select("vec_id", "component", "n", "deviation", "whitened", share.alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_exact")
