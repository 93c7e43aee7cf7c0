"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, several times. Each pass counts the scores of every query in a global
histogram over the interval that must hold its k-th highest score; the bucket with the k-th becomes the next interval,
until a bucket is one score wide. The last pass keeps the scores above the k-th and, of those equal to it, the smallest
vec_ids. Nothing but counts and at most 2k rows a query and task is shuffled; candidates never move.

Queries go in groups of at most GROUP_QUERIES vectors and GROUP_BYTES, which bounds what the driver holds, what is sent to
the executors and the counters of a task; each group is one set of passes over all candidates, and its answer is written
before the next group is read.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows without a vec_id, take no
part; shorter vectors count as padded with zeros; a row never matches rows of its own vec_id; rows with a repeated vec_id
are candidates each, and as queries are answered once by the vector that sorts first; an empty table gives no rows; ties go
to the smaller vec_id. Components are taken as floor(scale * x) and scores are exact; a component or a score that no long
can hold raises an OverflowError. Vectors may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path

GROUP_QUERIES = 8192
GROUP_BYTES = 32 << 20
BUCKET_BITS = 10
TILE = 2048
_LOWEST = -(1 << 63)
_FOUND = "query_id long, vec_id long, score long"


def _clean(vectors: DataFrame, scale: int) -> DataFrame:
    v = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return vectors.select("vec_id", "embedding").where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    col = batch.column(name)
    n = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy().astype(np.int64)
    width = int(n.max()) if len(n) else 0
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


class _Group:
    """The queries of one group and what a pass needs of them."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray):
        self.ids, self.mat = ids, mat
        self.peak = int(np.abs(mat).max()) if mat.size else 0

    def scores(self, ids: np.ndarray, mat: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first query, scores of some queries by candidates, mask of pairs that count)."""
        width = max(self.mat.shape[1], mat.shape[1])
        pad = lambda m: m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
        bound = width * self.peak * (int(np.abs(mat).max()) if mat.size else 0)
        kind = np.float64 if bound < 1 << 53 else np.int64
        c = pad(mat).astype(kind).T
        at = np.searchsorted(self.ids, ids)
        own = (at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == ids)
        for q in range(0, len(self.ids), 256):
            part = pad(self.mat[q : q + 256]).astype(kind)
            s = (part @ c).astype(np.int64)  # whole numbers modulo 2**64: right wherever the score fits
            ok = np.ones(s.shape, bool)
            mine = np.flatnonzero(own & (at >= q) & (at < q + 256))
            ok[at[mine] - q, mine] = False
            if bound >= 1 << 62 and (ok & (np.abs(part.astype(np.float64) @ c.astype(np.float64)) >= 2.0**63 * (1 - 1e-9))).any():
                raise OverflowError("a score does not fit in a long")
            yield q, s, ok


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for lo in range(0, b.num_rows, TILE):
            part = b.slice(lo, TILE)
            yield part.column("vec_id").to_numpy(), _matrix(part)


def _groups(queries: DataFrame) -> Iterator[_Group]:
    """The queries in bounded groups, in the order of vec_id."""
    ids: list[int] = []
    vecs: list[list[int]] = []
    size = 0

    def group() -> _Group:
        width = max(map(len, vecs))
        return _Group(np.array(ids, np.int64), np.array([x + [0] * (width - len(x)) for x in vecs], np.int64))

    for r in queries.orderBy("vec_id").toLocalIterator():
        if ids and (len(ids) >= GROUP_QUERIES or size + 8 * len(r.v) > GROUP_BYTES):
            yield group()
            ids, vecs, size = [], [], 0
        ids.append(r.vec_id)
        vecs.append(r.v)
        size += 8 * len(r.v)
    if ids:
        yield group()


def _kth(cands: DataFrame, group, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th highest score of each query (the lowest possible where there are fewer) and how many scores are higher."""
    n = len(group.value.ids)
    bits = max(1, bound.bit_length() + 1)
    low = np.full(n, -(1 << (bits - 1)), np.int64)
    need = np.full(n, k, np.int64)
    while bits > 0:
        shift = max(0, bits - BUCKET_BITS)
        low_, need_, shift_, size = low, need, shift, 1 << (bits - shift)

        def count(batches, low=low_, need=need_, shift=shift_, size=size):
            g = group.value
            hist = np.zeros((len(g.ids), size), np.int64)
            for ids, mat in _tiles(batches):
                for q, s, ok in g.scores(ids, mat):
                    from_low = s - low[q : q + 256, None]  # as unsigned, the distance whatever its size
                    b = from_low.view(np.uint64) >> np.uint64(shift)
                    ok &= (s >= low[q : q + 256, None]) & (b < size)
                    b = b.astype(np.int64)
                    b += (np.arange(len(s)) * size)[:, None]
                    hist[q : q + 256] += np.bincount(b[ok], minlength=len(s) * size).reshape(len(s), size)
            # lower buckets than that of this task's own k-th score can't hold the k-th of all
            over = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1] - hist
            q, b = np.nonzero((hist > 0) & (over < need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(hist[q, b])], names=["q", "bucket", "n"])

        hist = cands.mapInArrow(count, "q int, bucket int, n long").groupBy("q", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("q").orderBy(F.col("bucket").desc())
        cum = hist.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") - F.col("n") < k)
        # at most k buckets of each query of the group
        rows = cum.select("q", "bucket", "n", "upto").toPandas()
        rows = rows[rows["upto"] - rows["n"] < need[rows["q"]]]
        last = rows.sort_values("bucket").groupby("q").first()  # the lowest bucket that is still needed
        got = np.zeros(n, bool)
        at = last.index.to_numpy()
        got[at] = last["upto"].to_numpy() >= need[at]
        short = ~got  # fewer candidates than k: all of them
        need[at] -= (last["upto"] - last["n"]).to_numpy()
        low[at] += last["bucket"].to_numpy().astype(np.int64) << shift
        low[short], need[short] = _LOWEST, k
        bits = shift
    return low, k - need


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all other rows."""
    spark = vectors.sparkSession
    cands = materialize(_clean(vectors, scale), "topk-vectors")
    first = Window.partitionBy("vec_id").orderBy("v")
    queries = cands.where(is_query).withColumn("r", F.row_number().over(first)).where("r = 1").select("vec_id", "v")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    top = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    peak, widest = cands.agg(F.max(norm), F.max(top)).first()
    if (widest or 0.0) >= 2.0**63 * (1 - 1e-9):  # floor() has met the end of its range
        raise OverflowError("a component does not fit in a long")
    out = scratch_path(spark, "topk-found")
    groups = 0
    for g in _groups(queries):
        group = spark.sparkContext.broadcast(g)
        groups += 1
        bound = int((float((g.mat.astype(np.float64) ** 2).sum(axis=1).max()) * (peak or 0.0)) ** 0.5) + 1
        kth, above = _kth(cands, group, k, min(bound, (1 << 63) - 1))

        def keep(batches, group=group, kth=kth, need=k - above):
            g = group.value
            ties: dict[int, list[int]] = {}
            for ids, mat in _tiles(batches):
                for q, s, ok in g.scores(ids, mat):
                    t = kth[q : q + 256, None]
                    i, j = np.nonzero(ok & (s > t))
                    yield _rows(g.ids[q + i], ids[j], s[i, j])
                    i, j = np.nonzero(ok & (s == t))
                    o = np.lexsort((ids[j], i))
                    i, j = i[o], j[o]
                    r = np.arange(len(i)) - np.searchsorted(i, i)
                    r = np.flatnonzero(r < need[q + i])
                    for a, b in zip((q + i[r]).tolist(), ids[j[r]].tolist()):
                        have = ties.setdefault(a, [])
                        have.append(b)
                        if len(have) > 4 * need[a]:
                            ties[a] = sorted(have)[: int(need[a])]
            pairs = [(a, b) for a, have in ties.items() for b in sorted(have)[: int(need[a])]]
            a = np.array([x for x, _ in pairs], np.int64)
            yield _rows(g.ids[a], np.array([x for _, x in pairs], np.int64), kth[a])

        # the group's answer is written before the next one comes, so one group's vectors are in memory at a time
        cands.mapInArrow(keep, _FOUND).write.mode("append").parquet(out)
        group.destroy()
    union = spark.read.schema(_FOUND).parquet(out) if groups else spark.createDataFrame([], _FOUND)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return union.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rows(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])
