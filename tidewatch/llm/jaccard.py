"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles (hashes of lower-cased words; a text of one to four words is one
shingle). Equal sets are folded first; what follows works on distinct sets. In each run every set samples some of its
shingles, each with probability 1 / (threshold * size), by a hash of the run and the shingle, so that similar sets choose
the same ones; a sampled shingle is a child bucket. Buckets of at most BUCKET sets are compared by brute force; larger
ones are split again by another sample. A bucket that is still larger at the last level is compared whole as well, in
tiles of two groups of about BUCKET sets. A pair is compared if it shares LEAST buckets or more (pairs with one passage in
common share fewer); runs are so many that a pair at the threshold does with probability RECALL, whether its buckets are
those of the first level or of the last. Every candidate pair is verified on the full sets, and counted in the first of the
buckets it shares.

Pairs are never emitted: a bucket gives its members' link counts and a spanning forest of its links. Classes are the
connected components of the forests, by alternating star contraction on tables in shared storage. Among equal doc_ids the
text with the lowest hash leads. Very long texts are one set each, of all their shingles.

Defined cases: a document without words is alone; repeated rows are copies; null doc_ids take part, and a class's id is
its lowest doc_id (null if it has none); a document without links is its own class; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import free_names, materialize, release, text_chunks
from .textops import Prefix, chain, mix, ngrams, words

WIDTH = 5
#: Similarity of a link, as a fraction.
NUM, DEN = 4, 5
BUCKET = 256
RECALL = 0.99999
LEVELS = 2
LEAST = 3
_NULL = -(1 << 63)


def _shared(depth: int, upto: int) -> np.ndarray:
    """P(a pair at the threshold shares 0, 1, .. upto - 1 buckets of level `depth` in one run).

    It has sampled a Poisson number of shingles in common at each level, with mean 1 at least, the same ones below every
    bucket of a run: the shared buckets are the product of these numbers.
    """
    one = np.array([math.exp(-1) / math.factorial(k) for k in range(upto)])
    out = one
    for _ in range(depth - 1):
        p = np.zeros(upto)
        for i in range(1, upto):
            for j in range(1, (upto - 1) // i + 1):
                p[i * j] += out[i] * one[j]
        p[0] = 1 - (1 - out[0]) * (1 - one[0])
        out = p
    return out


def runs_for(recall: float, levels: int = LEVELS, least: int = LEAST) -> int:
    """Runs after which a pair at the threshold has shared `least` buckets with probability `recall`, at any level."""
    most = 1
    for depth in range(1, levels + 1):
        one = _shared(depth, least)
        total, runs = one, 1
        while total.sum() > 1 - recall:
            total, runs = np.convolve(total, one)[:least], runs + 1
        most = max(most, runs)
    return most


def _seed(run: int, level: int) -> np.uint64:
    return mix(np.array([(run * 8 + level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))[0]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, by document: (hashes, bounds)."""
    n = len(offsets) - 1
    s, e, doc = words(raw, offsets)
    h = chain(raw, s, e)
    at, g = ngrams(h, doc, WIDTH)
    gd = doc[at]
    count = np.bincount(doc, minlength=n)
    short = np.flatnonzero((count > 0) & (count < WIDTH))
    if len(short):
        first = np.searchsorted(doc, short)
        g = np.concatenate([g, Prefix(h).of(first, first + count[short])])
        gd = np.concatenate([gd, short])
    o = np.argsort((gd.astype(np.uint64) << np.uint64(44)) | (g >> np.uint64(20)))
    g, gd = g[o], gd[o]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (gd[1:] != gd[:-1])
    g, gd = g[new], gd[new]
    return g, np.searchsorted(gd, np.arange(n + 1))


def set_ids(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set, whatever the order of its members."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    size = np.diff(bounds).astype(np.uint64)
    return mix((total[bounds[1:]] - total[bounds[:-1]]) ^ mix(size + np.uint64(1)))


def _lower(batch: pa.RecordBatch) -> pa.RecordBatch:
    text = pc.utf8_lower(pc.fill_null(batch.column("text"), "").cast(pa.large_utf8()))
    return pa.RecordBatch.from_arrays([text if n == "text" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)


def _sample(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in map(_lower, batches):
            for lo, hi, raw, off in text_chunks(b):
                g, bounds = shingle_sets(raw, off)
                size = np.diff(bounds)
                doc = np.repeat(np.arange(hi - lo), size)
                bar = np.minimum(2.0**64 * DEN / (NUM * np.maximum(size, 1)), 2.0**64 - 2048).astype(np.uint64)[doc]
                cols = [b.column("doc_id").slice(lo, hi - lo), b.column("th").slice(lo, hi - lo), pa.array(set_ids(g, bounds).view(np.int64)), pa.array(size.astype(np.int64))]
                for level in range(LEVELS):
                    kept_d, kept_t, kept_r = [], [], []
                    for r in range(runs):
                        x = mix(g ^ _seed(r, level))
                        k = np.flatnonzero(x <= bar)
                        kept_d.append(doc[k])
                        kept_t.append(x[k])
                        kept_r.append(np.full(len(k), r, np.int32))
                    d, t, r = map(np.concatenate, (kept_d, kept_t, kept_r))
                    o = np.argsort(d, kind="stable")
                    cut = pa.array(np.searchsorted(d[o], np.arange(hi - lo + 1)).astype(np.int32))
                    pairs = pa.StructArray.from_arrays([pa.array(r[o]), pa.array(t[o].view(np.int64))], names=["r", "t"])
                    cols.append(pa.ListArray.from_arrays(cut, pairs))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "s", "n", *(f"l{k}" for k in range(1, LEVELS + 1))])

    levels = ", ".join(f"l{k} array<struct<r:int,t:long>>" for k in range(1, LEVELS + 1))
    return run, f"doc_id long, th long, s long, n long, {levels}"


def _buckets(rows: DataFrame) -> DataFrame:
    """`rows` (s, r, path) with the size of their bucket, without those alone."""
    sizes = rows.groupBy("path").agg(F.count("*").alias("c")).where("c > 1")
    return rows.join(sizes, "path")


def _leaves(reps: DataFrame) -> DataFrame:
    """(s, leaf, c): the buckets that are to be compared; those over BUCKET at the last level too."""
    spark = reps.sparkSession
    rows = reps.select("s", F.explode("l1").alias("x")).select("s", F.col("x.r").alias("r"), F.xxhash64("x.r", "x.t").alias("path"))
    found = []
    for level in range(1, LEVELS + 1):
        sized = materialize(_buckets(rows), f"jaccard-level{level}")
        last = level == LEVELS
        found.append(sized.where("true" if last else f"c <= {BUCKET}").select("s", F.col("path").alias("leaf"), "c"))
        large = sized.where(f"c > {BUCKET}")
        if last or large.isEmpty():
            break
        rows = large.join(reps.select("s", f"l{level + 1}"), "s").select("s", "r", "path", F.explode(F.filter(f"l{level + 1}", lambda x: x["r"] == F.col("r"))).alias("x"))
        rows = rows.select("s", "r", F.xxhash64("path", "x.t").alias("path")).distinct()
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    release(spark)
    return out


_TILES = "s long, tiles array<struct<leaf:long,g:int,a:int,b:int>>"
#: Sets of a task whose tiles are held together before they are sent.
HELD = 50_000


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set the tiles (rows sorted by tile) in which it has a pair of its own: one whose sizes allow the threshold,
    that shares enough leaves for a similar pair, and no earlier leaf than this. A set's tiles of this task go together."""
    held: list[pa.RecordBatch] = []
    wanted: dict[int, list[tuple[int, int, int, int]]] = {}

    def tile(t: pa.Table) -> np.ndarray:
        n, leaf = t.column("n").to_numpy(), t.column("leaf")[0].as_py()
        ok = (DEN * np.minimum.outer(n, n) >= NUM * np.maximum.outer(n, n)) & ~np.eye(len(n), dtype=bool)
        if t.column("a")[0].as_py() != t.column("b")[0].as_py():
            g = t.column("g").to_numpy()
            ok &= g[:, None] != g[None, :]
        if not ok.any():
            return np.zeros(len(n), bool)
        have = t.column("leaves").combine_chunks()
        flat, owner = have.flatten().to_numpy(), np.repeat(np.arange(len(n)), np.diff(have.offsets.to_numpy()))
        ok &= common_counts(flat, owner, len(n)) >= t.column("least")[0].as_py()
        before = flat < leaf
        return (ok & (common_counts(flat[before], owner[before], len(n)) == 0)).any(axis=1)

    def sent() -> pa.RecordBatch:
        tiles = [dict(zip(("leaf", "g", "a", "b"), x)) for have in wanted.values() for x in have]
        cut = np.concatenate([[0], np.cumsum([len(x) for x in wanted.values()])]).astype(np.int32)
        kind = pa.struct([("leaf", pa.int64()), ("g", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])
        return pa.RecordBatch.from_arrays([pa.array(list(wanted), pa.int64()), pa.ListArray.from_arrays(pa.array(cut), pa.array(tiles, kind))], names=["s", "tiles"])

    def settle(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        key = t.column("key").to_numpy()
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(cut[1:], len(key))
        done = len(cut) if last else len(cut) - 1
        for lo, hi in zip(cut[:done], ends[:done]):
            if hi - lo > 1 and (k := np.flatnonzero(tile(t.slice(lo, hi - lo)))).size:
                part = t.slice(lo, hi - lo).select(["s", "leaf", "g", "a", "b"]).take(pa.array(k))
                for s, *where in zip(*(part.column(c).to_pylist() for c in part.column_names)):
                    wanted.setdefault(s, []).append(tuple(where))
        if wanted and (last or len(wanted) > HELD):
            yield sent()
            wanted.clear()
        held[:] = [] if last else t.slice(int(cut[-1])).to_batches()

    for b in batches:
        if b.num_rows:
            yield from settle(pa.Table.from_batches([*held, b]), False)
    if held:
        yield from settle(pa.Table.from_batches(held), True)


def _tiles(leaves: DataFrame, reps: DataFrame) -> DataFrame:
    """(s, all its leaves, tiles): what each set has to be sent to.

    Tiles are first looked through without the sets, by sizes and by the leaves that pairs have in common: similar sets
    share far more of them than sets with one passage in common.
    """
    own = leaves.groupBy("s").agg(F.array_sort(F.collect_set("leaf")).alias("leaves")).join(reps.select("s", "n"), "s")
    groups = F.when(F.col("c") > BUCKET, F.ceil(F.col("c") / BUCKET)).otherwise(1).cast("int")
    dealt = leaves.join(own, "s").withColumn("groups", groups).withColumn("g", F.pmod(F.xxhash64("s", "leaf"), F.col("groups")).cast("int"))
    j = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("j")
    rows = dealt.select("s", "n", "leaves", "leaf", "g", F.when(F.col("groups") > 1, LEAST - 1).otherwise(LEAST).alias("least"), j)
    rows = rows.select("s", "n", "leaves", "leaf", "g", "least", F.least("g", "j").alias("a"), F.greatest("g", "j").alias("b"))
    rows = rows.withColumn("key", F.xxhash64("leaf", "a", "b"))
    dealt = rows.repartition("key").sortWithinPartitions("key")
    tiles = dealt.mapInArrow(_promising, _TILES).groupBy("s").agg(F.flatten(F.collect_list("tiles")).alias("tiles"))
    return tiles.join(own.select("s", "leaves"), "s")


_ROWS = "key long, leaf long, side int, cross boolean, s long, m long, leaves array<long>, tokens binary"


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each set and tile, with the set."""
    for b in map(_lower, batches):
        want, m, leaves, tiles = (b.column(c).to_pylist() for c in ("s", "m", "leaves", "tiles"))
        out: list[tuple] = []
        size = 0
        for lo, hi, raw, off in text_chunks(b):
            g, bounds = shingle_sets(raw, off)
            ids = set_ids(g, bounds).view(np.int64)
            for i in range(lo, hi):
                if ids[i - lo] != want[i]:  # another text of the same doc_id
                    continue
                tokens = g[bounds[i - lo] : bounds[i - lo + 1]].tobytes()
                for t in tiles[i]:
                    key = hash((t["leaf"], t["a"], t["b"]))
                    out.append((key, t["leaf"], t["g"], t["a"] != t["b"], want[i], m[i], leaves[i], tokens))
                    size += len(tokens)
                if size > 16 << 20:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    names = ["key", "leaf", "side", "cross", "s", "m", "leaves", "tokens"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def common_counts(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of n owners share; no owner has a value twice."""
    o = np.argsort(values, kind="stable")
    v, w = values[o], owner[o]
    new = np.append(True, v[1:] != v[:-1]) if len(v) else np.zeros(0, bool)
    col = np.cumsum(new) - 1
    shared = np.bincount(col, minlength=1)[col] > 1 if len(v) else np.zeros(0, bool)
    w, col = w[shared], col[shared]
    if not len(w):
        return np.zeros((n, n), np.int64)
    col = np.cumsum(np.append(True, col[1:] != col[:-1])) - 1
    total = np.zeros((n, n), np.float32 if col[-1] < 1 << 23 else np.float64)
    for lo in range(0, int(col[-1]) + 1, 2048):
        k = slice(*np.searchsorted(col, [lo, lo + 2048]))
        a = np.zeros((n, min(2048, int(col[-1]) + 1 - lo)), np.float32)
        a[w[k], col[k] - lo] = 1
        total += a @ a.T
    return total.astype(np.int64)


def _compare(table: pa.Table) -> pa.Table:
    """Link counts (s, n) and a spanning forest (s, t) of one tile."""
    s, first = np.unique(table.column("s").to_numpy(), return_index=True)
    n = len(s)
    take = table.take(pa.array(first))
    leaf = table.column("leaf")[0].as_py()
    sets = [np.frombuffer(x, np.uint64) for x in take.column("tokens").to_pylist()]
    size = np.array([len(x) for x in sets], np.int64)
    shared = common_counts(np.concatenate(sets), np.repeat(np.arange(n), size), n)
    link = (NUM + DEN) * shared >= NUM * (size[:, None] + size[None, :])
    np.fill_diagonal(link, False)
    if table.column("cross")[0].as_py():
        side = take.column("side").to_numpy()
        link &= side[:, None] != side[None, :]
    earlier = [[x for x in have if x < leaf] for have in take.column("leaves").to_pylist()]
    owner = np.repeat(np.arange(n), [len(x) for x in earlier])
    new = link & (common_counts(np.array([x for have in earlier for x in have], np.int64), owner, n) == 0)
    count = new @ take.column("m").to_numpy()
    root = np.arange(n)
    while True:  # lowest member of each component
        low = np.where(link, root[None, :], n).min(axis=1, initial=n)
        up = np.minimum(root, low)
        up = up[up]
        if (up == root).all():
            break
        root = up
    has, edge = np.flatnonzero(count), np.flatnonzero(root != np.arange(n))
    zero = np.zeros(len(edge), np.int64)
    return pa.table([pa.array(np.concatenate([s[has], s[edge]])), pa.array([None] * len(has) + s[root[edge]].tolist(), pa.int64()), pa.array(np.concatenate([count[has], zero]))], names=["s", "t", "n"])


def classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, th (hash of the text), root (of the class; null without words), class_id, n_links, n_shingles."""
    sample, schema = _sample(runs_for(recall))
    slim = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    signed = materialize(slim.mapInArrow(sample, schema), "jaccard-signatures")
    some = signed.where("n > 0")
    reps = materialize(some.groupBy("s").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"), F.first("n").alias("n"), *(F.first(f"l{k}").alias(f"l{k}") for k in range(1, LEVELS + 1))), "jaccard-sets")
    tiles = _tiles(materialize(_leaves(reps), "jaccard-leaves"), reps)
    needed = materialize(reps.select("s", "m", F.coalesce("rep", F.lit(_NULL)).alias("doc")).join(tiles, "s"), "jaccard-tiles")
    release(docs.sparkSession)
    texts = slim.withColumn("doc", F.coalesce("doc_id", F.lit(_NULL))).join(needed, "doc")
    rows = texts.select("text", "s", "m", "leaves", "tiles").mapInArrow(_spread, _ROWS)
    compared = materialize(rows.groupBy("key").applyInArrow(_compare, "s long, t long, n long"), "jaccard-links")
    release(docs.sparkSession)
    links = compared.where("t is null").groupBy("s").agg(F.sum("n").alias("linked"))
    root = components(compared.where("t is not null").select(F.col("s").alias("a"), F.col("t").alias("b")))
    node = reps.select("s", "rep", "m").join(root, "s", "left").withColumn("root", F.coalesce("root", "s"))
    lowest = node.groupBy("root").agg(F.min("rep").alias("class_id"))
    node = materialize(node.join(lowest, "root").join(links, "s", "left").select("s", "root", "class_id", (F.col("m") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "jaccard-classes")
    full = some.select("doc_id", "th", "s", "n").join(node, "s").select("doc_id", "th", "root", "class_id", "n_links", F.col("n").alias("n_shingles"))
    none = F.lit(0).cast("long")
    return full.unionByName(signed.where("n = 0").select("doc_id", "th", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_shingles")))


def near_duplicates(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links (other documents at the threshold or over it, copies too), n_shingles."""
    return classes(docs, recall).select("doc_id", "class_id", "n_links", "n_shingles")


def keep_one_of_each_class(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One document, with its columns, of each class: that of the lowest doc_id, of rows that repeat it the text with the
    lowest hash. All documents without words stay."""
    found = materialize(classes(docs, recall), "jaccard-found")
    lead = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("x")).select("x.doc_id", "x.th")
    own_th, doc, th = free_names(docs, "text_th", "lead_doc", "lead_th")
    keys = materialize(lead.unionByName(found.where("root is null").select("doc_id", "th").distinct()).select(F.col("doc_id").alias(doc), F.col("th").alias(th)), "jaccard-kept")
    here = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own_th) == F.col(th))
    kept = docs.withColumn(own_th, F.xxhash64(F.coalesce("text", F.lit("")))).join(keys, here, "left_semi")
    again = materialize(found.where("root is not null").groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias(doc), F.col("th").alias(th)), "jaccard-repeated")
    if not again.isEmpty():  # rows repeated whole
        kept = kept.join(again, here, "left_anti").unionByName(kept.join(again, here, "left_semi").dropDuplicates(["doc_id", own_th]))
    return kept.drop(own_th)
