"""Consistent weighted sampling: fingerprints of word counts whose collision rate is the generalised Jaccard similarity.

For each of K samples a word of weight w draws r and c from Gamma(2, 1) and b uniformly, all from hashes of the word;
t = floor(ln w / r + b), and the word with the least ln c - r (t - b) - r is the sample, together with t (Ioffe, Improved
Consistent Sampling). Only DataFrame functions are used; the numpy functions are the same by plain steps, for comparison.
Most words of most texts are a few words with a small count: their samples are made once and joined, the rest as they come.

Words are lower-cased in A-Z and lie between spaces and the ASCII controls from tab to carriage return. Null texts count
as empty; texts without words have the empty fingerprint, which is like itself (1.0) and unlike others (0.0). Null
doc_ids come last in descending order; rows that share a doc_id are ordered by a hash of their texts. An empty table
gives an empty result. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_BREAK, partitions, written

SAMPLES = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BITS = 25
_MARK = 20

#: Words with a count whose samples are made once, and documents, about, in which the most frequent are looked for.
KNOWN, LOOKED_AT = 1 << 15, 5_000


def _uniform(z: Column, shift: int) -> Column:
    return (F.shiftrightunsigned(z, shift).bitwiseAND(F.lit((1 << _BITS) - 1)) + F.lit(0.5)) * F.lit(2.0**-_BITS)


def sample(term: str, n: str, k: int) -> Column:
    """A long that orders by the sample's value and carries a mark of (term, t) in its low bits."""
    one, two = F.xxhash64(F.col(term), F.lit(k)), F.xxhash64(F.lit(k), F.col(term))
    r = -F.log(_uniform(one, 0) * _uniform(one, 25))
    c = -F.log(_uniform(two, 0) * _uniform(two, 25))
    b = (F.shiftrightunsigned(one, 50).bitwiseAND(F.lit(16383)) * F.lit(16384) + F.shiftrightunsigned(two, 50).bitwiseAND(F.lit(16383)) + F.lit(0.5)) * F.lit(2.0**-28)
    t = F.floor(F.log(F.col(n)) / r + b)
    low = F.lit((1 << _MARK) - 1)

    def placed(value: Column, mark: Column) -> Column:
        # The value lies between -100 and 10: u and v have 25 bits each and a weight has less than 40.
        return F.shiftleft(F.floor((value + 200) * F.lit(2.0**32)), _MARK).bitwiseOR(mark.bitwiseAND(low))

    own = F.shiftrightunsigned(F.col(term), k % 40)
    # Of a word that is there once, t is 0.
    return F.when(F.col(n) == 1, placed(F.log(c) - r * (0 - b) - r, own)).otherwise(placed(F.log(c) - r * (t - b) - r, own.bitwiseXOR(t)))


def counted(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, term (a word's hash) and n of every word of every text."""
    words = texts.select(*keys, F.explode(F.split(F.translate(text, _UPPER, _LOWER), WORD_BREAK)).alias("word")).where("word <> ''").select(*keys, F.xxhash64("word").alias("term"))
    return words.groupBy(*keys, "term").agg(F.count("*").alias("n"))


def known_samples(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """term, n and known (their samples) of words and counts that are frequent in some documents; which ones has no influence on any result."""
    some = docs.sample(min(1.0, LOOKED_AT / max(docs.count(), 1)), 7).select(F.monotonically_increasing_id().alias("k"), "text")
    often = counted(some, ["k"], "text").groupBy("term", "n").agg(F.count("*").alias("times")).where("times > 1").orderBy(F.desc("times")).limit(KNOWN)
    return often.groupBy("term", "n").agg(F.array(*(F.min(sample("term", "n", k)) for k in range(samples))).alias("known"))


def signatures(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES, known: DataFrame | None = None) -> DataFrame:
    """keys and sig (array of samples) of every text with words; rows with equal keys are one text. known is by known_samples.

    Where texts is already dealt out by some of the keys, no further shuffle takes place.
    """
    weighted, of = counted(texts, keys, text), [sample("term", "n", k) for k in range(samples)]
    if known is not None:
        weighted = weighted.join(F.broadcast(known), ["term", "n"], "left")
        of = [F.coalesce(F.get("known", F.lit(k)), own) for k, own in enumerate(of)]
    least = weighted.groupBy(*keys).agg(*(F.min(own).alias(f"s{k}") for k, own in enumerate(of)))
    return least.select(*keys, F.array(*(F.col(f"s{k}").bitwiseAND(F.lit((1 << _MARK) - 1)).cast("int") for k in range(samples))).alias("sig"))


#: Words that the plain sampler takes at once, and their distinct weights at once.
_ROWS, _VALUES = 1 << 16, 1 << 10
_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _xxhash(x: np.ndarray, seed: np.ndarray, size: int) -> np.ndarray:
    """Spark's xxhash64 of ints (size 4) and longs (size 8) after a seed."""
    one, two, three, four, five = _PRIMES
    h = seed + five + np.uint64(size)
    h = _turned(h ^ x * one, 23) * two + three if size == 4 else _turned(h ^ _turned(x * two, 31) * one, 27) * one + four
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    return h ^ h >> np.uint64(32)


def _gamma(h: np.ndarray) -> np.ndarray:
    """Gamma(2, 1) from the low 50 bits of hashes."""
    low, high = ((((h >> np.uint64(k)) & np.uint64((1 << _BITS) - 1)).astype(np.float64) + 0.5) * 2.0**-_BITS for k in (0, 25))
    return -np.log(low * high)


def _values(terms: np.ndarray, counts: np.ndarray, samples: int) -> np.ndarray:
    """sample of each word and count, by numpy."""
    k, seed = np.arange(samples, dtype=np.uint64), np.full((1, 1), 42, np.uint64)
    one, two = _xxhash(k, _xxhash(terms[:, None], seed, 8), 4), _xxhash(terms[:, None], _xxhash(k, seed, 4), 8)
    r, c = _gamma(one), _gamma(two)
    b = (((one >> np.uint64(50)) & np.uint64(16383)) * np.uint64(16384) + ((two >> np.uint64(50)) & np.uint64(16383)) + 0.5) * 2.0**-28
    t = np.floor(np.log(counts)[:, None] / r + b)
    place = np.floor((np.log(c) - r * (t - b) - r + 200) * 2.0**32).astype(np.int64)
    mark = (terms[:, None] >> (np.arange(samples, dtype=np.uint64) % np.uint64(40))).view(np.int64) ^ t.astype(np.int64)
    return place << _MARK | mark & ((1 << _MARK) - 1)


def _least(terms: np.ndarray, counts: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """The marks of the samples of texts, whose words start at starts; words that share term and count are sampled once in a block."""
    out = np.full((len(starts), samples), np.iinfo(np.int64).max)
    for low in range(0, len(terms), _ROWS):
        high = min(low + _ROWS, len(terms))
        distinct, of = np.unique(terms[low:high], return_inverse=True)
        most = int(counts[low:high].max()) + 1
        pairs, place = np.unique(of * most + counts[low:high], return_inverse=True)
        found = np.concatenate([_values(distinct[p // most], p % most, samples) for p in np.split(pairs, range(_VALUES, len(pairs), _VALUES))])
        # Texts of the block: the one that is open at its start, and those that start in it.
        first, last = np.searchsorted(starts, low, "right") - 1, np.searchsorted(starts, high, "left")
        for text in range(first, last):
            rows = place[max(starts[text], low) - low : (min(starts[text + 1], high) if text + 1 < len(starts) else high) - low]
            if len(rows):
                out[text] = np.minimum(out[text], found[rows].min(0))
    return (out & ((1 << _MARK) - 1)).astype(np.int32)


def fingerprint(sig: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 5, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.lit(float(samples)))


def with_next(docs: DataFrame) -> DataFrame:
    """Adds bucket, h, and the next row's doc_id, h and text in descending order of doc_id; after the last comes the first.

    Ids are dealt to ranges by their quantiles. Each range also gets the first row of the range after it, so no window
    spans the table; the ranges are as many as four times the shuffle partitions.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = base.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100_000)).first()[0] or []
    cuts = sorted(set(cuts))
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    keyed = base.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(below)).withColumn("h", F.xxhash64("text"))
    tops = keyed.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("top")).orderBy(F.desc("bucket")).collect()  # one row for each range
    if not tops:
        return keyed.withColumns({"next_id": F.col("doc_id"), "next_h": F.col("h"), "next_text": F.col("text")})
    heads = [(tops[i - 1].bucket, tops[i].bucket, tops[i].top.doc_id, tops[i].top.h) for i in range(len(tops))]
    heads = F.broadcast(spark.createDataFrame(heads, "for_bucket int, bucket int, head_id long, head_h long"))
    extra = keyed.join(heads, "bucket").where(F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))).select("doc_id", "text", F.col("for_bucket").alias("bucket"), "h", F.lit(1).alias("extra"))
    order = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), F.desc("h"))
    both = keyed.select("doc_id", "text", "bucket", "h", F.lit(0).alias("extra")).union(extra)
    # As many tasks as ranges, so that the words of a task's texts are counted in memory.
    both = both.repartition(n, "bucket")
    found = both.select("doc_id", "text", "bucket", "h", "extra", *(F.lead(c).over(order).alias(a) for c, a in (("doc_id", "next_id"), ("h", "next_h"), ("text", "next_text"))))
    return found.where("extra = 0").drop("extra")


def edited_pairs(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    placed = with_next(docs).withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("left(next_text, cast(floor(length(text) / 2) as int))")))
    facts = placed.select("bucket", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "doc_id", "h", "next_id", "next_h", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.xxhash64("edited").alias("edited_h"))
    sides = placed.select("bucket", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.explode(F.array(F.struct(F.col("h").alias("text_h"), F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.xxhash64("edited").alias("text_h"), F.lit(1).alias("side"), F.col("edited").alias("body")))).alias("x"))
    sides = sides.select("bucket", "id", "x.side", "x.text_h", "x.body")
    # Where ids are unique, an id and side name one text, and the count of words needs no more.
    id_or_none = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    if docs.groupBy(id_or_none.alias("id")).count().where("count > 1").limit(1).count():
        # Rows that repeat id and text would add up their words: each is one text.
        sides, keys = sides.dropDuplicates(["bucket", "id", "side", "text_h"]), ["text_h"]
    else:
        keys = []
    sigs = written(signatures(sides, ["bucket", "id", "side", *keys], "body", samples, known_samples(docs, samples)), "signatures")
    renamed = lambda name: [F.col(k).alias(name) for k in keys]
    own = sigs.where("side = 0").select("bucket", "id", *renamed("h"), "sig")
    edited = sigs.where("side = 1").select("bucket", "id", *renamed("edited_h"), F.col("sig").alias("edited_sig"))
    following = sigs.where("side = 0").groupBy(F.col("id").alias("n_id"), *renamed("next_h")).agg(F.first("sig").alias("next_sig"))
    out = written(facts, "facts").join(own, ["bucket", "id", *(["h"] if keys else [])], "left").join(edited, ["bucket", "id", *(["edited_h"] if keys else [])], "left")
    out = out.withColumn("n_id", F.coalesce("next_id", F.lit(-(2**63)))).join(following, ["n_id", *(["next_h"] if keys else [])], "left")
    sig, edit, nxt = F.col("sig"), F.col("edited_sig"), F.col("next_sig")
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprint(sig).alias("fingerprint"), fingerprint(edit).alias("edited_fingerprint"), likeness(sig, edit, samples).alias("near_edited"), likeness(sig, nxt, samples).alias("near_next"))
