"""Quality of texts: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader updates.

A text is cut into words, runs of letters and digits or of other signs, as bytes. Its one- to three-word n-grams, each
hashed to one of 2**BITS places, are a sparse vector of damped counts of length one; a score is the logistic function of
its dot product with the weights. Every coordinate keeps the sum of its shifted gradients and of their squares, from which
the proximal update gives its weight, zero where the evidence stays under L1.

The fit takes at most SAMPLE labelled documents outside the held-out fold, those with the lowest hashes of doc_id: their
vectors are made where their texts lie, and one task goes through the sample, which does not grow with the corpus. Scoring
is one pass over all texts.

Defined cases: null and empty texts have no word, and the score of the intercept; a null doc_id is scored and never
learned from; labels that contradict each other or are null are not learned from, of rows with one doc_id the least text
is; without labels of both classes every score is the share of label 1 (0.5 without labels); very long texts are taken
whole, one at a time beyond a chunk; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_chunks
from .textops import WS, Prefix, chain, mix, runs_of

BITS = 18
GRAMS = (1, 2, 3)
#: Most labelled documents that are learned from.
SAMPLE = 6000
EPOCHS = 4
#: Step size, its damping, and the weights of the absolute and squared penalties.
ALPHA, BETA, L1, L2 = 4.0, 0.05, 0.002, 0.0
THRESHOLD = 0.5

_KIND = np.full(256, 2, np.uint8)
_KIND[WS] = 0
_KIND[[c for c in range(128) if chr(c).isalnum()]] = 1
_KIND[128:] = 1


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, values, bounds) of the sparse vectors of a chunk's documents."""
    n = len(offsets) - 1
    s, e, doc = runs_of(_KIND[raw], offsets)
    h = chain(raw, s, e)
    pre, keys = Prefix(h), []
    for k in GRAMS:
        at = np.flatnonzero(doc[: max(len(h) - k + 1, 0)] == doc[k - 1 :])
        place = mix(pre.of(at, at + k) + np.uint64(k)) >> np.uint64(64 - BITS)
        keys.append(doc[at].astype(np.uint64) << np.uint64(BITS) | place)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    of = (key >> np.uint64(BITS)).astype(np.int64)
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(of, weights=value * value, minlength=n))
    bounds = np.searchsorted(of, np.arange(n + 1))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int32), (value / norm[of]).astype(np.float32), bounds


class Leader:
    """Weights that follow the regularised leader; the last place is the intercept."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, place: np.ndarray, value: np.ndarray, y: int) -> None:
        """One document: predict, then move every coordinate that it has."""
        at, x = np.append(place, 1 << BITS), np.append(value, 1.0).astype(float)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(vectors: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """The weights after EPOCHS passes over (places, values, label), in an order of each pass's own."""
    leader, rng = Leader(), np.random.default_rng(5)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(vectors)):
            leader.learn(*vectors[k])
    return leader.weights().astype(np.float32)


def score(weights: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    place, value, bounds = features(raw, offsets)
    total = np.concatenate([[0.0], np.cumsum(weights[place].astype(float) * value)])
    return 1 / (1 + np.exp(-np.clip(total[bounds[1:]] - total[bounds[:-1]] + float(weights[-1]), -35, 35)))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, raw, off in text_chunks(b):
            place, value, bounds = features(raw, off)
            cut = pa.array(bounds.astype(np.int32))
            cols = [b.column("doc_id").slice(lo, hi - lo), b.column("y").slice(lo, hi - lo), pa.ListArray.from_arrays(cut, pa.array(place)), pa.ListArray.from_arrays(cut, pa.array(value))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "y", "place", "value"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        ids, ys = b.column("doc_id").to_pylist(), b.column("y").to_pylist()
        rows += [(i, b.column("place")[k].values.to_numpy(), b.column("value")[k].values.to_numpy(), y) for k, (i, y) in enumerate(zip(ids, ys))]
    rows.sort(key=lambda r: r[0])
    labels = [r[3] for r in rows]
    share = sum(labels) / len(labels) if labels else 0.5
    if 0 < share < 1:
        weights = train([r[1:] for r in rows])
    else:
        weights = np.zeros((1 << BITS) + 1, np.float32)
        weights[-1] = np.clip(np.log(share / (1 - share)) if 0 < share < 1 else (share - 0.5) * 70, -35, 35)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["w"])


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The weights, from a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    agreed = known.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("hi")).where("y = hi")
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", F.col("y").cast("int").alias("y"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # SAMPLE rows at most
    one = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = one.mapInArrow(_vectors, "doc_id long, y int, place array<int>, value array<float>").repartition(1).mapInArrow(_fit, "w binary").first()
    return np.frombuffer(got.w, np.float32)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for b in batches:
            for lo, hi, raw, off in text_chunks(b):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(score(weights, raw, off))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
