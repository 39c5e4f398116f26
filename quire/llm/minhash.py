"""MinHash near-duplicates by tensored banding, with links confirmed on full shingle sets.

Two collections of half keys, each of a few minhashes, are combined pair by pair into table keys: m + m half keys give
m * m tables, so a document needs the minhashes of 2m half keys instead of those of m * m whole ones.

Documents with equal sets are one class. A class is dropped as a partner where its sets of shingles that no other
candidate has already rule every link out. Each class is first compared with the most central class of its buckets; what
then still lies in one bucket but in different components is told apart by exact bounds on what classes lack of their
centre and add to it, cell by cell, and only what these leave is compared on full sets. No candidate is capped or sampled.

Null and empty texts have no shingles. A very long text is one row with its whole set, held by one task at a time.

Null and empty texts link with nothing; so do rows with a null doc_id, whose component is null.
Rows that share a doc_id are told apart by the hashes of their sets. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, texts
from .common import dropped, written
from .components import components
from .shingles import mixed, shingle_sets

#: Minhashes of a half key, and words of parity bits of a set.
HALF = 4
PARITY = 16
SEED = np.uint64(0x5851F42D4C957F2D)


def half_keys(percent: int, half: int = HALF, miss: float = 5e-4) -> int:
    """How many half keys a side needs so that a pair at the threshold is missed with probability miss at most."""
    return max(2, math.ceil(math.log(1 - math.sqrt(1 - miss)) / math.log(1 - (percent / 100) ** half)))


def _minhashes(sets: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """count rows of minhashes; texts without shingles get zeros."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((count, len(bounds) - 1), np.uint64)
    if len(full):
        for k in range(count):
            seed = mixed(np.array([k + 1], np.uint64) * SEED)[0]
            out[k, full] = np.minimum.reduceat((sets ^ seed) * (seed | np.uint64(1)), bounds[:-1][full])
    return out


def _set_hashes(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    filled = np.concatenate([[np.uint64(0)], np.cumsum(mixed(sets ^ SEED))]), np.concatenate([[np.uint64(0)], np.cumsum(mixed(sets + SEED))])
    return tuple((x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in filled)


def signatures(docs: DataFrame, m: int, half: int = HALF, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (hashes of the set), a and b (m half keys each)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets, bounds = shingle_sets(texts(part), words)
                low = _minhashes(sets, bounds, 2 * m * half)
                keys = np.zeros((2 * m, part.num_rows), np.uint64)
                for k in range(half):
                    keys = mixed(keys * np.uint64(31) + low[k::half])
                h1, h2 = _set_hashes(sets, bounds)
                columns = [part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(h1), pa.array(h2)]
                ends = pa.array(np.arange(part.num_rows + 1) * m, pa.int32())
                columns += [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(side.T).view(np.int64).ravel())) for side in (keys[:m], keys[m:])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "h1", "h2", "a", "b"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, a array<long>, b array<long>")


def sets_of(docs: DataFrame, words: int = 5) -> DataFrame:
    """c (class), n, items (sorted shingle hashes), parity (bits that each element flips one of) of docs with a class c, its n and h2, and text; only rows whose set is that of c."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets, bounds = shingle_sets(texts(part), words)
                n = part.num_rows
                owner = np.repeat(np.arange(n), np.diff(bounds))
                place = (sets % np.uint64(64 * PARITY)).astype(np.int64)
                odd = np.bincount(owner * 64 * PARITY + place, minlength=n * 64 * PARITY) & 1
                bits = np.packbits(odd.astype(np.uint8).reshape(n, -1), axis=1).view(np.int64)
                h1, h2 = _set_hashes(sets, bounds)
                own = (h1 == part.column("c").to_numpy()) & (h2 == part.column("h2").to_numpy()) & (np.diff(bounds) == part.column("n").to_numpy())
                out = pa.RecordBatch.from_arrays([part.column("c"), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64))), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * PARITY, pa.int32()), pa.array(bits.ravel()))], ["c", "n", "items", "parity"])
                yield out if own.all() else out.filter(pa.array(own))

    return docs.select("c", "n", "h2", "text").mapInArrow(run, "c long, n long, items array<long>, parity array<long>")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) and what else they have, with the full sets of both as items_u and items_v."""
    left = sets.select(F.col("c").alias("u"), F.col("items").alias("items_u"))
    right = sets.select(F.col("c").alias("v"), F.col("items").alias("items_v"))
    return pairs.join(left, "u").join(right, "v")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    both = F.size(F.array_intersect("items_u", "items_v")).cast("long")
    return _with_sets(pairs.select("u", "v"), sets).where(both * (100 + percent) >= percent * (F.size("items_u") + F.size("items_v"))).select("u", "v")


def _parity_distance(x: str, y: str) -> Column:
    return reduce(lambda a, b: a + b, (F.bit_count(F.get(x, k).bitwiseXOR(F.get(y, k))) for k in range(PARITY)))


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), kept (doc_id = component_id)."""
    return _placed_rows(docs, percent, words)[0]


def _placed_rows(docs: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """The rows of near_duplicates, and h1, component and component_id of every class."""
    m = half_keys(percent)
    rows = written(signatures(docs, m, words=words), "signatures")
    classes = written(rows.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b")).select(F.col("h1").alias("c"), "h2", F.col("n_shingles").alias("n"), "rep", "a", "b"), "classes")
    links = _links(docs, classes, m, percent, words)
    joined = classes.select("c", "rep").join(components(links), F.col("c") == F.col("node"), "left").select("c", "rep", F.coalesce("component", "c").alias("component"))
    joined = written(joined, "class-components")
    dropped(docs.sparkSession, classes, links)
    least = written(joined.groupBy("component").agg(F.min("rep").alias("component_id")), "component-ids")
    of_class = written(joined.join(least, "component").select(F.col("c").alias("h1"), "component", "component_id"), "component-of-class")
    out = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("h1")).alias("h1")).join(of_class.drop("component"), "h1", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), of_class


def _links(docs: DataFrame, classes: DataFrame, m: int, percent: int, words: int) -> DataFrame:
    """Links (u, v) between classes whose closure is that of all links among classes that share a table key."""
    spark = docs.sparkSession
    halves = classes.select("c", F.posexplode(F.concat("a", "b")).alias("side", "value"))
    shared = written(halves.groupBy("side", "value").agg(F.count("*").alias("k")).where("k > 1").select("side", "value"), "shared-halves")
    own = halves.join(shared, ["side", "value"]).groupBy("c").agg(F.array_sort(F.collect_list(F.when(F.col("side") < m, F.struct("side", "value")))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("side") >= m, F.struct("side", "value")))).alias("b"))
    own = written(own.where("size(a) > 0 and size(b) > 0"), "half-keys")
    candidates = own.select("c").join(classes.select("c", "h2", "n", "rep"), "c")
    sets = written(_candidate_sets(docs, candidates, words), "candidate-sets")

    # Shingles that only one candidate has can't be shared: they bound every similarity of that candidate.
    items = sets.select("c", F.explode(F.transform("items", lambda x: F.shiftright(x, 32).cast("int"))).alias("item"))
    single = items.groupBy("item").agg(F.count("*").alias("k"), F.min("c").alias("c")).where("k = 1").groupBy("c").agg(F.count("*").alias("alone"))
    bounded = sets.select("c", "n", "parity").join(single, "c", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    bounded = written(bounded.where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")), "bounded")

    keyed = own.join(bounded.select("c", "n", "alone"), "c").select("c", (F.col("alone") / F.col("n")).alias("share"), F.explode("a").alias("x"), "b").select("c", "share", "x", F.explode("b").alias("y")).select("c", "share", F.xxhash64("x.side", "x.value", "y.side", "y.value").alias("key"))
    centre = keyed.groupBy("key").agg(F.count("*").alias("k"), F.min(F.struct("share", "c")).alias("centre")).where("k > 1").select("key", F.col("centre.c").alias("v"), F.col("centre.share").alias("share"))
    centre = written(centre, "bucket-centres")
    # Classes of one bucket meet in the group of its centre: one row for each class and centre, whatever tables they share.
    grouped = written(keyed.select("c", "key").join(centre, "key").groupBy("v", "c").agg(F.min("share").alias("share")), "grouped")
    stars = grouped.where("c <> v").groupBy(F.col("c").alias("u")).agg(F.min(F.struct("share", "v")).alias("best")).select("u", "best.v")
    linked = written(_linked(stars, sets, percent), "star-links")
    dropped(spark, own, centre)

    labels = written(components(linked), "star-components")
    placed = grouped.select("v", "c").join(labels, F.col("c") == F.col("node"), "left").select("v", "c", F.coalesce("component", "c").alias("component"))
    placed = written(placed, "placed")
    open_groups = placed.groupBy("v").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("v")
    members = written(placed.join(written(open_groups, "open-groups"), "v").select("v", F.col("c").alias("u"), "component"), "members")
    dropped(spark, grouped, labels, placed)
    pairs = written(_open_pairs(members, sets, percent), "open-pairs")
    dropped(spark, members)
    left = bounded.select(F.col("c").alias("u"), F.col("n").alias("n_u"), F.col("parity").alias("p_u"))
    right = bounded.select(F.col("c").alias("v"), F.col("n").alias("n_v"), F.col("parity").alias("p_v"))
    # Each differing element flips one parity bit, so the distance bounds the sets' difference from below.
    near = pairs.join(left, "u").join(right, "v").where(_parity_distance("p_u", "p_v") * (100 + percent) <= (100 - percent) * (F.col("n_u") + F.col("n_v"))).select("u", "v")
    out = written(linked.union(_linked(near, sets, percent)), "links")
    dropped(spark, sets, bounded, linked, pairs)
    return out


def _open_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of one group in different components that no bound rules out.

    members has v (the group's centre), u and component. A member is the centre less what it lacks plus what it adds.
    Two members differ by d_u + d_w less twice what they both lack and both add, and can share only what more than one
    member of the group lacks or adds. These four numbers rule most pairs out, and they do so for whole cells of members
    with like numbers before any pair is made: a group has as many cells as scales of the numbers, not as members.
    """
    lacks = F.array_except("items_v", "items_u")
    adds = F.array_except("items_u", "items_v")
    facts = written(_with_sets(members, sets).select("v", "u", "component", F.size("items_u").alias("n"), lacks.alias("lacks"), adds.alias("adds")), "differences")
    each = facts.select("v", "u", F.explode(F.concat(F.transform("lacks", lambda x: F.struct(F.lit(True).alias("lack"), x.alias("item"))), F.transform("adds", lambda x: F.struct(F.lit(False).alias("lack"), x.alias("item"))))).alias("x")).select("v", "u", "x.lack", "x.item")
    alone = each.groupBy("v", "lack", "item").agg(F.count("*").alias("k"), F.min("u").alias("u")).where("k = 1").groupBy("v", "u").agg(F.count_if("lack").alias("own_lacks"), F.count_if(~F.col("lack")).alias("own_adds"))
    sized = facts.select("v", "u", "component", "n", F.size("lacks").alias("l"), F.size("adds").alias("a")).join(alone, ["v", "u"], "left")
    row = sized.select("v", "u", "component", "n", (F.col("l") + F.col("a")).alias("d"), (F.col("l") - F.coalesce("own_lacks", F.lit(0))).alias("l"), (F.col("a") - F.coalesce("own_adds", F.lit(0))).alias("a"))
    scale = [F.floor(F.log1p(F.col(x)) * 8).cast("long") for x in ("d", "l", "a", "n")]
    rows = written(row.withColumn("cell", ((scale[0] * 1024 + scale[1]) * 1024 + scale[2]) * 1024 + scale[3]), "profiles")
    dropped(members.sparkSession, facts)
    cells = written(rows.groupBy("v", "cell").agg(F.min("d").alias("d"), F.max("l").alias("l"), F.max("a").alias("a"), F.max("n").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")), "cells")

    def named(frame: DataFrame, end: str) -> DataFrame:
        return frame.select("v", *(F.col(c).alias(f"{c}_{end}") for c in frame.columns if c != "v"))

    def within() -> Column:
        least = F.col("d_x").cast("long") + F.col("d_y") - 2 * F.least("l_x", "l_y") - 2 * F.least("a_x", "a_y")
        return (100 + percent) * least <= (100 - percent) * (F.col("n_x").cast("long") + F.col("n_y"))

    meet = named(cells, "x").join(named(cells, "y"), "v").where((F.col("cell_x") <= F.col("cell_y")) & within() & (F.least("low_x", "low_y") != F.greatest("high_x", "high_y")))
    meet = written(meet.select("v", "cell_x", "cell_y"), "cell-pairs")
    found = meet.join(named(rows, "x"), ["v", "cell_x"]).join(named(rows, "y"), ["v", "cell_y"])
    found = found.where((F.col("component_x") != F.col("component_y")) & ((F.col("cell_x") < F.col("cell_y")) | (F.col("u_x") < F.col("u_y"))) & within())
    return found.select(F.least("u_x", "u_y").alias("u"), F.greatest("u_x", "u_y").alias("v")).distinct()


def _candidate_sets(docs: DataFrame, candidates: DataFrame, words: int) -> DataFrame:
    """The sets of the candidates, from the text of each class's first document."""
    known = candidates.select(F.col("rep").alias("doc_id"), "c", "h2", "n")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id").select("c", "h2", "n", "text")
    got = sets_of(found, words)
    return got.dropDuplicates(["c"])


def _with_h1(docs: DataFrame, words: int) -> DataFrame:
    """row (all columns) and h1, the hash of its set; null where the set is empty."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets, bounds = shingle_sets(texts(part), words)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(_set_hashes(sets, bounds)[0], mask=np.diff(bounds) == 0)], ["row", "h1"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return rows.mapInArrow(run, T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("h1", T.LongType())]))


def without_near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """The rows of docs that stand for their component, as they are; of rows that share doc_id and component, one stays.

    Rows whose doc_id is repeated are told apart by the hashes of their sets; those with empty sets count as equal.
    """
    found, of_class = _placed_rows(docs, percent, words)
    found = written(found, "placed-rows")
    repeated = written(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    keep = found.where("kept").select("doc_id").distinct()
    if repeated.limit(1).count() == 0:
        return _only(docs, keep)
    once = _only(docs, keep.join(repeated, "doc_id", "left_anti"))
    again = _with_h1(_only(docs, repeated), words).join(of_class, "h1", "left")
    again = again.where(F.coalesce(F.col("row.doc_id").cast("long") == F.col("component_id"), F.lit(True)))
    # A row without shingles has no class: it stands for itself.
    again = again.groupBy("row.doc_id", "component").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.union(again.select("row.*"))


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with one of the ids, null included."""
    ids = written(ids.select("doc_id"), "kept-ids")
    return docs.join(ids, docs.doc_id.cast("long").eqNullSafe(ids.doc_id), "left_semi")
