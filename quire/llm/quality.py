"""Quality by Bradley-Terry ranking: preference pairs of labelled documents teach a linear score, a score quantile is the threshold.

The features are counts over the whole text; id, language, source and labels are never among them. Null texts count as
empty; an empty text has the features of no words and a score like any other. Rows are scored one by one, repeated
ones too, and null doc_ids are scored but never learned from. Without labels of both kinds every score is 0.7, so that
nothing is rejected. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, texts
from .common import written

#: Byte classes: lower case, upper case, digits, blanks, line ends, sentence marks, loud marks, bars, symbols, other ASCII marks, rest.
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:", b"!?", b"|", b"#$%&*@^~", b"\"'()-/<=>[]_`{}+\\")
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CLASS_OF[list(_chars)] = _k
_N_CLASSES = len(_CLASSES) + 1
#: Shares that are also taken as logarithms.
_SHARES = _N_CLASSES + 6
N_FEATURES = 2 * _SHARES + 3
CUT_SCORE = 0.7


def _per_text(bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: how many distinct codes, the count of the commonest, and how many codes equal the one before."""
    n, counts = len(bounds) - 1, np.diff(bounds)
    owner = np.repeat(np.arange(n), counts)
    top = int(codes.max()) + 1 if len(codes) else 1
    pairs, times = np.unique(owner * top + codes, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, pairs // top, times)
    same = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(pairs // top, minlength=n), most, np.bincount(owner[1:][same], minlength=n)


def _codes(text: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    parts = pc.split_pattern(text, pattern)
    bounds = parts.offsets.to_numpy()
    return bounds - bounds[0], parts.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def features(text: pa.Array) -> np.ndarray:
    """A row of N_FEATURES numbers for each text (large strings without nulls)."""
    n = len(text)
    sizes = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(x.as_buffer() for x in text.cast(pa.large_binary())), np.uint8)
    owner = np.repeat(np.arange(n) * _N_CLASSES, sizes)
    kinds = np.bincount(owner + _CLASS_OF[data], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
    bounds, codes = _codes(pc.replace_substring_regex(text, "[\\t\\r\\n]", " "), " ")
    words = np.maximum(np.diff(bounds), 1)
    distinct, most, repeats = _per_text(bounds, codes)
    line_bounds, line_codes = _codes(text, "\n")
    lines, (line_distinct, _, _) = np.maximum(np.diff(line_bounds), 1), _per_text(line_bounds, line_codes)
    shares = np.column_stack([kinds / np.maximum(sizes, 1)[:, None], distinct / words, most / words, repeats / words, line_distinct / lines, kinds[:, 6] / words, kinds[:, 8] / words])
    return np.column_stack([shares, np.log(shares + 0.002), np.log1p(sizes), np.log1p(words), np.log1p(sizes / words)])


@dataclass(frozen=True)
class Model:
    """score = sigmoid(weights . features - threshold + logit(0.7)); all numbers are small and fixed in count."""

    weights: tuple[float, ...]
    threshold: float
    level: float

    def score(self, rank: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(self.threshold - float(np.log(CUT_SCORE / (1 - CUT_SCORE)))) - rank))


def fit_pairs(better: np.ndarray, worse: np.ndarray, pairs_each: int = 6, penalty: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights that minimise the mean logistic loss of weight . (better - worse) over pairs, by Newton steps on scaled features."""
    scale = np.concatenate([better, worse]).std(axis=0)
    scale[scale < 1e-9] = 1.0
    n = max(len(better), len(worse)) * pairs_each
    k = np.arange(n)
    d = (better[(k * 7919 + k // len(better)) % len(better)] - worse[(k + k // len(worse) * 31) % len(worse)]) / scale
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = penalty * w - d.T @ p / n
        curve = (d * (p * (1 - p))[:, None]).T @ d / n + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def with_features(docs: DataFrame, column: str) -> DataFrame:
    """docs with the features of its text in a new column; all other columns pass through."""
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = features(texts(part))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * N_FEATURES, pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, column])

    return docs.mapInArrow(run, schema)


def rank_of(feature_column: str, weights: tuple[float, ...]) -> Column:
    return sum((F.get(feature_column, i) * F.lit(w) for i, w in enumerate(weights)), F.lit(0.0))


def fit(featured: DataFrame, labels: DataFrame, learn: Column, max_rows: int = 20_000) -> Model:
    """Learns from labels.quality of rows where learn holds.

    featured has doc_id and features of all documents, labels has doc_id and quality. At most max_rows labelled rows,
    those with the smallest id hashes, are used (the documented bound of the sample); the quantiles are those of all
    documents. Of the levels 0.001 to 0.999 whose quantiles part the labels best (within 0.01), the one with the widest
    step to the next is taken, and the threshold lies in the middle of that step.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = featured.where(learn & F.col("doc_id").isNotNull()).join(known, "doc_id").select("quality", "features", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(max_rows)
    rows = sample.select("quality", "features").toPandas()
    x, y = np.array(rows.features.tolist(), float).reshape(-1, N_FEATURES), rows.quality.to_numpy()
    if not (0 < y.sum() < len(y)):
        return Model((0.0,) * N_FEATURES, 0.0, 0.0)
    w = tuple(float(v) for v in fit_pairs(x[y == 1], x[y == 0]))
    levels = [k / 1000 for k in range(1, 1000)]
    cuts = np.array(featured.select(rank_of("features", w).alias("rank")).agg(F.percentile_approx("rank", levels, 10_000)).first()[0])
    ranks = x @ np.array(w)
    good, bad = np.sort(ranks[y == 1]), np.sort(ranks[y == 0])
    right = 1 - np.searchsorted(good, cuts) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    near = np.flatnonzero((right[:-1] >= right.max() - 0.01) & (right[1:] >= right.max() - 0.01))
    k = near[np.argmax(np.diff(cuts)[near])] if len(near) else np.argmax(right)
    return Model(w, float(cuts[k : k + 2].mean()), levels[k])


def scored(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted, rank and the threshold's quantile level of every row of docs."""
    featured = written(with_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "features").drop("text"), "quality-features")
    model = fit(featured, labels, ~held_out)
    ranked = featured.select("doc_id", held_out.alias("held_out"), rank_of("features", model.weights).alias("rank"))
    return ranked.withColumn("score", model.score(F.col("rank"))).select("doc_id", "held_out", "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"), "rank", F.lit(model.level).alias("level"))


def kept(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """The rows of docs that the classifier does not reject, as they are."""
    name = "features"
    while name in docs.columns:
        name += "_"
    model = fit(written(with_features(docs.select("doc_id", "text"), "features").drop("text"), "quality-features"), labels, ~held_out)
    return with_features(docs, name).where(model.score(rank_of(name, model.weights)) >= CUT_SCORE).select(*docs.columns)
