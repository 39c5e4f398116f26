"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction; a vector passes it when its cosine to the direction reaches a bound (it lies in the filter's cap).
The directions are all sums of one codeword from each block of dimensions, after a random rotation (a random product code),
so a vector's filters are listed by a search over blocks that goes on only where the best of the rest could still reach the
bound. The filters of one code pass together, so they are dealt to CODES codes. The bound and the number of codewords follow
from the number of vectors: a cap holds about `occupancy` of them, and two vectors at the linking cosine share `shared`
filters on average. Vectors that share a filter are compared.

Groups of any size: equal vectors are one class. Where a filter holds many classes, they are compared with its smallest one,
and those within half the linking angle form a ball: any two of a ball are linked by the triangle inequality, so neither
pairs nor comparisons are made inside it. Filters then are joined by balls, and only different balls are compared, in blocks
of members.

Links are only those with a cosine of at least the bound in doubles; at the bound itself up to 1 in 200 pairs share no
filter, above it fewer. Vectors that are null, empty, zero or hold null or non-finite entries are
linked with nothing, nor are vectors of different lengths. Rows with a null or repeated id keep their own rows; a null id
takes no part in the smallest id, and a component of null ids only has null for it. An empty table gives an empty result.
Columns beside the two named are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import gather
from .common import dropped, written
from .components import components
from .vectors import finite, matrices

#: Codes of their own rotation, so that no vector misses the caps of all; blocks of dimensions of a code.
CODES, BLOCKS = 32, 3
#: Classes in a filter from which balls are sought; members of a ball that are compared at a time.
CROWD, MEMBERS = 8, 64
#: Parts of a large ball that are joined apart.
PARTS = 32
_EDGE = 1e-9


class Code:
    """The product codes for vectors of one length: rotations, codewords of each block, and the bound."""

    def __init__(self, size: int, count: int, cosine: float, shared: float, occupancy: float):
        blocks = min(BLOCKS, size)
        cap, both = _shares(size, cosine)
        at = np.linspace(0.0, 1.0, len(cap))
        k = int(np.searchsorted(-cap, -min(0.25, occupancy / max(count, 1))))
        k = min(k, len(cap) - 2, int(np.flatnonzero(both > 1e-18).max(initial=0)))
        self.bound, self.filters = float(at[k]), shared / both[k]
        self.words = max(2, math.ceil((self.filters / CODES) ** (1 / blocks)))
        rng = np.random.default_rng(size * 7919 + 13)
        cuts = [size * b // blocks for b in range(blocks + 1)]
        self.codes = []
        for _ in range(CODES):
            turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
            words = [rng.standard_normal((b - a, self.words)) for a, b in zip(cuts, cuts[1:])]
            # A rotation and a block's codewords in one matrix: all scores of a block come from one product.
            self.codes.append([turn[:, a:b] @ (w / np.linalg.norm(w, axis=0) * math.sqrt((b - a) / size)) for a, b, w in zip(cuts, cuts[1:], words)])

    def passed(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that a row of unit vectors passes."""
        found = [self._listed(unit, code) for code in self.codes]
        row = np.concatenate([r for r, _ in found])
        return row, np.concatenate([n + k * self.words ** len(self.codes[k]) for k, (_, n) in enumerate(found)])

    def _listed(self, unit: np.ndarray, code: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        scores = [unit @ block for block in code]
        best = [s.max(1) for s in scores]
        row, number, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, score in enumerate(scores):
            rest = sum(best[k + 1 :], np.zeros(len(unit)))
            order = np.argsort(-score, axis=1)
            falling = np.take_along_axis(score, order, 1)
            # One search for all: row r's scores, falling, stand at 8 r - score, and those of different rows lie apart.
            moved = (np.arange(len(unit))[:, None] * 8.0 - falling).ravel()
            least = np.clip(self.bound - total - rest[row], -2.0, 2.0)
            ends = np.searchsorted(moved, row * 8.0 - least, side="right") - row * self.words
            own = np.repeat(np.arange(len(row)), ends)
            place = gather(np.zeros(len(row), np.int64), ends)
            total = total[own] + falling[row[own], place]
            number = number[own] * self.words + order[row[own], place]
            row = row[own]
        return row, number


def _shares(size: int, cosine: float, steps: int = 2000, inner: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """For bounds from 0 to 1: the share of directions within a cap, and of those within the caps of both of two vectors at a cosine."""
    x = np.linspace(0.0, 1.0, steps + 1)
    density = np.maximum(1 - x * x, 0.0) ** ((size - 3) / 2) if size > 2 else 1 / np.sqrt(np.maximum(1 - x * x, 1e-6))
    tail = np.cumsum(density[::-1])[::-1] - density / 2
    cap = np.maximum(tail / (2 * tail[0]), 0.0)
    y = np.linspace(-1.0, 1.0, inner + 1)
    across = np.maximum(1 - y * y, 0.0) ** ((size - 4) / 2) if size > 3 else np.ones_like(y)
    upper = np.cumsum(across[::-1])[::-1] / across.sum()
    reach = math.sqrt(1 - cosine * cosine)
    both = np.empty_like(x)
    for k, bound in enumerate(x):
        z = x[k:]
        need = (bound - cosine * z) / np.maximum(reach * np.sqrt(np.maximum(1 - z * z, 1e-12)), 1e-12)
        both[k] = (density[k:] * np.interp(need, y, upper, left=1.0, right=0.0)).sum() / (2 * density.sum())
    return cap, both


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(classes: DataFrame, codes: dict[int, Code]) -> DataFrame:
    """key, size, filter for every filter that a class passes."""

    def run(batches):
        for batch in batches:
            for rows, entries in matrices(batch, "v"):
                code = codes[entries.shape[1]]
                for k in range(0, len(rows), 512):
                    row, number = code.passed(_unit(entries[k : k + 512]))
                    keys = batch.column("key").take(pa.array(rows[k : k + 512][row]))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(row), entries.shape[1]), pa.int32()), pa.array(number)], ["key", "size", "filter"])

    return classes.select("key", "v").mapInArrow(run, "key long, size int, filter long")


def _cosines(pairs: DataFrame, least: float) -> DataFrame:
    """a, b of the pairs (a, b, va, vb) with at least that cosine."""

    def run(batches):
        for batch in batches:
            for rows, left in matrices(batch, "va"):
                right = next(m for _, m in matrices(batch.take(pa.array(rows)), "vb"))
                near = rows[(_unit(left) * _unit(right)).sum(1) >= least]
                yield batch.select(["a", "b"]).take(pa.array(near))

    return pairs.mapInArrow(run, "a long, b long")


def _balls(classes: DataFrame, passed: DataFrame, cosine: float) -> DataFrame:
    """key, ball (a class's key): classes of crowded filters that lie within half the linking angle of their ball's class."""
    half = math.sqrt((1 + cosine) / 2) + _EDGE
    crowds = passed.groupBy("size", "filter").agg(F.count("*").alias("n"), F.min("key").alias("centre")).where(F.col("n") >= CROWD)
    tries = passed.join(crowds, ["size", "filter"]).select(F.col("key").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = tries.join(classes.select(F.col("key").alias("a"), F.col("v").alias("va")), "a").join(classes.select(F.col("key").alias("b"), F.col("v").alias("vb")), "b")
    return _cosines(pairs, half).groupBy("a").agg(F.min("b").alias("ball")).withColumnRenamed("a", "key")


def _compared(pairs: DataFrame, cosine: float) -> DataFrame:
    """key, links, other: of each block pair, the members' links to the other block, and another class of their component there."""

    def run(batches):
        for batch in batches:
            sides = [[batch.column(c + s) for c in ("keys", "weights", "vectors")] for s in ("_l", "_r")]
            sizes = [np.asarray(side[0].value_lengths(), dtype=np.int64) for side in sides]
            starts = [np.cumsum(s) - s for s in sizes]
            flat = [(s[0].flatten().to_numpy(), s[1].flatten().to_numpy()) for s in sides]
            width = batch.column("size").to_numpy()
            values = [s[2].flatten().flatten().to_numpy() for s in sides]
            firsts = [np.concatenate([[0], np.cumsum(n * width)]) for n in sizes]
            units = [[None] * batch.num_rows, [None] * batch.num_rows]
            out = [[], [], []]
            single = (sizes[0] == 1) & (sizes[1] == 1)
            for w in np.unique(width[single]):  # pairs of single classes, all at once
                rows = np.flatnonzero(single & (width == w))
                left, right = (_unit(values[s][firsts[s][rows][:, None] + np.arange(w)]) for s in (0, 1))
                rows = rows[(left * right).sum(1) >= cosine]
                a, b = flat[0][0][starts[0][rows]], flat[1][0][starts[1][rows]]
                out[0] += [a, b]
                out[1] += [flat[1][1][starts[1][rows]], flat[0][1][starts[0][rows]]]
                out[2] += [b, a]
            for r in np.flatnonzero(~single):
                for s in (0, 1):
                    units[s] = _unit(values[s][firsts[s][r] : firsts[s][r + 1]].reshape(-1, width[r]))
                near = units[0] @ units[1].T >= cosine
                (a, wa), (b, wb) = ((flat[s][0][starts[s][r] : starts[s][r] + sizes[s][r]], flat[s][1][starts[s][r] : starts[s][r] + sizes[s][r]]) for s in (0, 1))
                rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                out[0] += [a[rows], b[columns]]
                out[1] += [near[rows] @ wb, wa @ near[:, columns]]
                out[2] += [b[near[rows].argmax(1)], a[near[:, columns].argmax(0)]]
            joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in joined], ["key", "links", "other"])

    return pairs.mapInArrow(run, "key long, links long, other long")


def near_duplicates(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, shared: float = 24.0, occupancy: float = 1.0) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of the table."""
    spark = table.sparkSession
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    usable = finite(F.col("v")) & (F.size("v") > 0) & F.exists("v", lambda x: x != 0)
    linked = rows.where(usable)
    classes = linked.groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("key"), F.col("v").cast("array<double>").alias("v"), F.size("v").alias("size"), "n", "first_id"), "classes")
    lengths = {r["size"]: r["count"] for r in classes.groupBy("size").count().collect()}  # one row for each length of a vector
    codes = {size: Code(size, count, cosine, shared, occupancy) for size, count in lengths.items()}
    passed = written(_filters(classes, codes), "passed-filters")
    balls = written(_balls(classes, passed, cosine), "balls")

    members = classes.join(balls, "key", "left").withColumn("ball", F.coalesce("ball", "key"))
    # Balls of more than one class get their size by a part of the ball, so that a large one is not in one task.
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS))
    sized = members.groupBy("ball").agg(F.count("*").alias("in_ball"), F.sum("n").alias("ball_rows")).where("in_ball > 1")
    sized = sized.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    members = members.withColumn("part", part).join(sized, ["ball", "part"], "left").withColumns({"in_ball": F.coalesce("in_ball", F.lit(1)), "ball_rows": F.coalesce("ball_rows", "n")})
    block = F.pmod(F.xxhash64("key", F.lit(1)), F.ceil(F.col("in_ball") / MEMBERS))
    members = written(members.select("key", "v", "size", "n", "first_id", "ball", "in_ball", "ball_rows", block.alias("block")), "members")
    whole = F.struct("key", "n", "v")
    blocks = members.groupBy("ball", "block", "size").agg(F.collect_list(whole).alias("m"))  # about MEMBERS of them
    blocks = written(blocks.select("ball", "size", F.col("m.key").alias("keys"), F.col("m.n").alias("weights"), F.col("m.v").alias("vectors")), "blocks")

    entered = passed.join(balls, "key", "left").select("size", "filter", F.coalesce("ball", "key").alias("ball")).distinct()
    # A class may be its own ball's centre and a member of another ball; ball names then are still one for each set of members.
    other = entered.select("size", "filter", F.col("ball").alias("right"))
    meeting = entered.withColumnRenamed("ball", "left").join(other, ["size", "filter"]).where("left < right").select("left", "right").distinct()
    sides = {s: blocks.select(F.col("ball").alias(name), *(F.col(c).alias(c + s) for c in ("keys", "weights", "vectors")), *(["size"] if s == "_l" else [])) for s, name in (("_l", "left"), ("_r", "right"))}
    found = written(_compared(meeting.join(sides["_l"], "left").join(sides["_r"], "right"), cosine), "links")
    dropped(spark, passed, blocks)

    edges = found.select(F.col("key").alias("u"), F.col("other").alias("v")).union(members.where("key <> ball").select(F.col("key").alias("u"), F.col("ball").alias("v")))
    edges = edges.where("u <> v")
    return _labelled(rows, usable, members, found, components(edges))


def _labelled(rows: DataFrame, usable, members: DataFrame, found: DataFrame, component: DataFrame) -> DataFrame:
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = members.join(counts, "key", "left").join(component.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    links = F.coalesce("links", F.lit(0)) + F.col("ball_rows") - 1
    known = written(known.join(least, "component").select(F.col("v").alias("w"), links.cast("long").alias("n_links"), "component_id"), "labels")
    out = rows.where(usable).withColumn("w", F.col("v").cast("array<double>")).join(known, "w").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
