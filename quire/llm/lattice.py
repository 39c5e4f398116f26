"""Subword lattice likelihood: log10 probability of whole texts, summed over all segmentations into pieces.

The pieces and their scores are those of an existing vocabulary. Its scores are ranks (0, -1, -2, ...), read as Zipf's
law: a piece of rank r has weight 1 / (r + 2). A word is spelled, a sum over all segmentations into pieces by a forward
recursion in log space, or drawn whole, by its discounted count in the training documents. Both are edges of one
lattice, and with the end of the document they share one unit of mass.

Words of one batch go through the recursion together, place by place; a word of more than LONG characters goes alone, so
a very long text without white space takes memory in proportion to its length.

Null texts count as empty: one end token. Null doc_ids are scored and follow the rule of an empty id. Repeated rows are
scored one by one. An empty table gives an empty result; without training documents words are spelled only. Columns
beside doc_id and text are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import slices, texts
from .common import dropped, written
from .shingles import mixed

MARK = "▁"
DISCOUNT = 0.75
#: A word with at least this share of all tokens is scored where it stands; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 100_000
#: Characters of the longest word that goes through the recursion with others, and the share of spelled words that ends.
LONG, END_SHARE = 256, 0.2
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[str, int], list[int], np.ndarray]:
    """Slot of each piece, slots of the 256 bytes, and the log weight of each slot; the last slot is the end of a word."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    scores = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or MARK in piece[1:]):
            scores[piece] = model.get_score(i)
    n = len(scores)
    # Bytes stand behind all pieces, as a fallback that never has a score of its own.
    ranks = np.concatenate([-np.array(list(scores.values())), np.full(256, -min(scores.values(), default=0.0) + 1)])
    weights = np.log(1 / (ranks + 2)) - np.log(np.sum(1 / (ranks + 2))) + math.log(1 - END_SHARE)
    return {piece: k for k, piece in enumerate(scores)}, list(range(n, n + 256)), np.append(weights, math.log(END_SHARE))


class Lattice:
    """The pieces as a table of hashes of their characters, and the forward recursion over many words at once."""

    def __init__(self, slot: dict[str, int], byte_slots: list[int], weights: np.ndarray):
        self.slot, self.byte_slots, self.weights = slot, byte_slots, weights
        self.longest = max(map(len, slot), default=1)
        hashes = np.array([self._hash(p) for p in slot] or [0], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array([weights[k] for k in slot.values()] or [-np.inf])[order]
        self.shift = np.uint64(64 - 20)
        self.likely = np.zeros(1 << 20, bool)  # whether any piece has these high bits
        self.likely[(self.hashes >> self.shift).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in mixed(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _STEP):
            h = mixed(h * _STEP + c)
        return h[0]

    def _score(self, h: np.ndarray) -> np.ndarray:
        """Log weight of the piece with each hash; minus infinity where there is none."""
        out = np.full(len(h), -np.inf)
        k = np.flatnonzero(self.likely[(h >> self.shift).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.hashes, h[k]), len(self.hashes) - 1)
        hit = self.hashes[i] == h[k]
        out[k[hit]] = self.scores[i[hit]]
        return out

    def spelled(self, words: list[str]) -> np.ndarray:
        """Natural log of the sum over all segmentations of each word with its leading mark, and of the word's end."""
        out = np.zeros(len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = forward(words[i], self.slot, self.byte_slots, self.longest, self.weights)[0][-1]
        short = np.flatnonzero(sizes <= LONG)
        short = short[np.argsort(-sizes[short], kind="stable")]
        for k in range(0, len(short), 20_000):
            part = short[k : k + 20_000]
            out[part] = self._together([MARK + words[i] for i in part.tolist()], sizes[part])
        return out + self.weights[-1]

    def _together(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """The recursion over words in falling order of their sizes: at each place the longer ones are a prefix of them."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        coded = mixed(chars + _STEP)
        first = np.cumsum(sizes) - sizes
        top = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(1, top + 1), "right")  # words of at least 1, 2, ... characters
        alpha = np.full((top + 1, len(words)), -np.inf)
        alpha[0] = 0
        reach = np.zeros((self.longest, len(words)), np.uint64)  # hashes of the characters from each of the last places on
        for j in range(1, top + 1):
            n = active[j - 1]
            c = coded[first[:n] + j - 1]
            terms = []
            # A hash that starts at place i lives in row i modulo longest and grows by the character at j.
            for i in range(max(0, j - self.longest), j):
                row = reach[i % self.longest, :n]
                row[:] = mixed((np.uint64(0) if i == j - 1 else row) * _STEP + c)
                w = self._score(row)
                if i == j - 1:
                    w = np.where(w > -np.inf, w, self._bytes(chars[first[:n] + j - 1], w))
                terms.append(alpha[i, :n] + w)
            terms = np.array(terms)
            best = terms.max(axis=0)
            alpha[j, :n] = best + np.log(np.exp(terms - best).sum(axis=0))
        return alpha[sizes, np.arange(len(words))]

    def _bytes(self, chars: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Log weight of each character that is no piece as its bytes."""
        odd, inverse = np.unique(chars[scores == -np.inf], return_inverse=True)
        out = np.zeros(len(chars))
        out[scores == -np.inf] = np.array([sum(self.weights[self.byte_slots[b]] for b in chr(c).encode("utf-8", "surrogatepass")) for c in odd.tolist()] or [0.0])[inverse] if len(odd) else 0
        return out


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(*pieces(path))


def edges(word: str, slot: dict[str, int], byte_slots: list[int], longest: int):
    """(from, to, slots) of every piece in the word with its leading mark; a character that is no piece is its bytes."""
    s = MARK + word
    for j in range(1, len(s) + 1):
        found = False
        for i in range(max(0, j - longest), j):
            k = slot.get(s[i:j])
            if k is not None:
                found |= i == j - 1
                yield i, j, (k,)
        if not found:
            yield j - 1, j, tuple(byte_slots[b] for b in s[j - 1].encode("utf-8", "surrogatepass"))


def forward(word: str, slot, byte_slots, longest: int, weights: list[float]) -> tuple[list[float], list]:
    """Log probability of every prefix over all its segmentations, and the edges with their log weights."""
    alpha = [0.0] + [-math.inf] * (len(word) + 1)
    arcs, terms, at = [], [], 0
    for i, j, ks in edges(word, slot, byte_slots, longest):
        if j != at:
            if terms:
                top = max(terms)
                alpha[at] = top + math.log(sum(math.exp(t - top) for t in terms))
            terms, at = [], j
        w = weights[ks[0]] if len(ks) == 1 else sum(weights[k] for k in ks)
        terms.append(alpha[i] + w)
        arcs.append((i, j, ks, w))
    top = max(terms)
    alpha[at] = top + math.log(sum(math.exp(t - top) for t in terms))
    return alpha, arcs


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a batch, the word code of every token, and n + 1 bounds of the texts."""
    spaced = pc.ascii_trim(pc.replace_substring_regex(pc.ascii_lower(text), "[\\x20\\x09-\\x0D]+", " "), " ")
    parts = pc.split_pattern(spaced, " ")
    bounds = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds - bounds[0]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (tokens in documents where learn holds), seen (in all); the empty word stands for the end."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                known, codes, bounds = words_of(texts(part))
                learn = np.repeat(part.column("learn").to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
                n = len(known)
                rows = [known, pa.array(np.bincount(codes[learn], minlength=n)), pa.array(np.bincount(codes, minlength=n))]
                table = pa.RecordBatch.from_arrays([rows[0].cast(pa.string()), rows[1], rows[2]], ["word", "c", "seen"])
                yield table.filter(pc.not_equal(table.column("word"), ""))

    found = docs.select("text", "learn").mapInArrow(run, "word string, c long, seen long")
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def scored(docs: DataFrame, path: str, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out")).withColumn("learn", ~F.col("held_out"))
    words = written(word_counts(rows), "words")
    ends = rows.agg(F.count_if("learn")).first()[0]
    v, inside, seen = words.agg(F.count_if(F.col("c") > 0), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    n, kinds = inside + ends, v + (ends > 0)
    smooth = n + 0.5 * (kinds + 1)
    share = DISCOUNT * v / n if n else 0.5
    end_score = math.log10(ends / n) if ends else math.log10(0.5)
    end_base = math.log10((ends + 0.5) / smooth)

    def score_words(batches):
        for batch in batches:
            c = batch.column("c").to_numpy()
            spelled = lattice(path).spelled(batch.column("word").to_pylist())
            whole = np.log(np.maximum(c - DISCOUNT, 0) / n if n else np.zeros(len(c)), where=c > 0, out=np.full(len(c), -np.inf))
            score = np.logaddexp(whole, spelled + math.log(share if share else 1e-9)) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), batch.column("seen"), pa.array(np.log10((c + 0.5) / smooth)), pa.array(score)], ["word", "c", "seen", "base", "score"])

    table = written(words.mapInArrow(score_words, "word string, c long, seen long, base double, score double"), "word-scores")
    dropped(spark, words)
    # At most 1 / HOT_SHARE rows, whatever the input.
    hot = table.where(F.col("seen") >= max(1, seen * HOT_SHARE)).select("word", (F.col("c") > 0).cast("double").alias("known"), "base", "score").toPandas()
    hot_words, hot_facts = pa.array(hot.word, pa.large_string()), hot[["known", "base", "score"]].to_numpy(float)

    def spread(batches):
        """Each document's distinct words that are not hot, and one row (null word) with the sums of the others."""
        for batch in batches:
            for part in slices(batch, "text"):
                known, codes, bounds = words_of(texts(part))
                place = pc.fill_null(pc.index_in(known.cast(pa.large_string()), value_set=hot_words), -1).to_numpy(zero_copy_only=False)
                info = np.concatenate([hot_facts, np.zeros((1, 3))])[place]
                void = pc.equal(known, "").to_numpy(zero_copy_only=False)
                rows_n = part.num_rows
                owner = np.repeat(np.arange(rows_n), np.diff(bounds))
                real = ~void[codes] if len(codes) else np.zeros(0, bool)
                owner, codes = owner[real], codes[real]
                sums = [np.bincount(owner, info[codes, k], minlength=rows_n) for k in range(3)]
                tokens = np.bincount(owner, minlength=rows_n)
                cold = place[codes] < 0
                pairs, times = np.unique(owner[cold] * max(len(known), 1) + codes[cold], return_counts=True)
                who, what = pairs // max(len(known), 1), pairs % max(len(known), 1)
                ids, keys, sides = (part.column(x) for x in ("doc_id", "row_key", "held_out"))
                empty = pa.nulls(rows_n, pa.string())
                columns = ["doc_id", "row_key", "held_out", "word", "times", "tokens", "known", "base", "score"]
                yield pa.RecordBatch.from_arrays([ids, keys, sides, empty, pa.array(np.ones(rows_n, np.int64)), pa.array(tokens + 1), pa.array(sums[0].astype(np.int64) + (ends > 0)), pa.array(sums[1] + end_base), pa.array(sums[2] + end_score)], columns)
                zero = np.zeros(len(who))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), keys.take(pa.array(who)), sides.take(pa.array(who)), known.cast(pa.string()).take(pa.array(what)), pa.array(times), pa.array(zero.astype(np.int64)), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero)], columns)

    keyed = rows.select("doc_id", "text", "held_out", F.xxhash64("doc_id", "text").alias("row_key"))
    out = keyed.mapInArrow(spread, "doc_id long, row_key long, held_out boolean, word string, times long, tokens long, known long, base double, score double")
    out = written(out, "document-words")  # read twice below
    cold = out.where("word is not null").select("doc_id", "row_key", "word", "times").join(table.select("word", "c", F.col("base").alias("word_base"), F.col("score").alias("word_score")), "word")
    cold = cold.groupBy("doc_id", "row_key").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.col("word_base")).alias("more_base"), F.sum(F.col("times") * F.col("word_score")).alias("more_score"), F.sum("times").alias("seen_times"))
    whole = out.where("word is null").withColumn("cold_id", F.col("doc_id"))
    # Rows that repeat another are counted with it in cold, so their sums are shared out.
    same = whole.groupBy("doc_id", "row_key").agg(F.count("*").alias("copies"), F.first("held_out").alias("held_out"), F.first("tokens").alias("n_tokens"), F.first("known").alias("known"), F.first("base").alias("base"), F.first("score").alias("score"))
    joined = same.join(cold, same.doc_id.eqNullSafe(cold.doc_id) & (same.row_key == cold.row_key), "left").select(same.doc_id, "held_out", "n_tokens", (F.col("known") + F.coalesce(F.col("more_known") / F.col("copies"), F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce(F.col("more_base") / F.col("copies"), F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce(F.col("more_score") / F.col("copies"), F.lit(0.0))).alias("score"), "copies")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")
