"""Incidents: items whose series move together and whose anomalies started together.

Charts and ranks are SQL over the flagged items. Correlations are blocks of a matrix product; where close pairs are all
that the linkage asks for, a metric index keeps series apart that can't be close. The linkage runs on each connected
component of the close pairs: in one task up to `max_items` items, beyond that in rounds over a table of distances. Complete
linkage of more items at a wide `corr_eps`, where close pairs would grow with the square of the items, takes its first rounds on the
series themselves. Average linkage needs the distances of all pairs, and a component of more items is an error for it, never a cut.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Clustering
from ..functions.scalar import key_family
from ..functions.sequence import linear_fill
from ..scratch import materialize
from .graph import components
from .stats import cycle_units, grid_unit, median_gap


#: A grid of more buckets is taken for a clock that is far off.
MAX_BUCKETS = 1_000_000


#: What tells the cycle of an item, where the items of several cycles are looked at together.
Cycle = Callable[[Column], Column]


def _with_unit(rows: DataFrame, unit: DataFrame, cycle: Cycle | None) -> DataFrame:
    if cycle is None:
        return rows.crossJoin(F.broadcast(unit))  # unit: one row
    return rows.withColumn("cycle", cycle(F.col("itemid"))).join(unit, "cycle").drop("cycle")


def usable_items(history: DataFrame, unit: DataFrame, cycle: Cycle | None = None) -> DataFrame:
    """Items sampled at least half as often as the grid; those with one sample have no gap and are out."""
    return _with_unit(median_gap(history), unit, cycle).where(F.col("gap") <= 2.0 * F.col("unit")).select("itemid")


def build_charts(history: DataFrame, unit: DataFrame, cycle: Cycle | None = None) -> DataFrame:
    """(itemid, bucket, value): each item's mean on the full grid (of its cycle), gaps filled in both directions. Buckets are by
    `at` instead of `clock` where there is such a column."""
    of = cycle or (lambda _: F.lit(0))
    rows = _with_unit(history.where("value is not null"), unit, cycle)
    when = F.col("at") if "at" in history.columns else F.col("clock")
    means = rows.groupBy("itemid", F.floor(when / F.col("unit")).alias("bucket")).agg(F.avg("value").alias("value"))
    ends = means.groupBy(of(F.col("itemid")).alias("cycle")).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    wide = F.raise_error(F.lit(f"the samples' clocks span more than {MAX_BUCKETS} buckets"))
    ends = ends.select("cycle", F.when(F.col("hi") - F.col("lo") < MAX_BUCKETS, F.col("lo")).otherwise(wide.cast("long")).alias("lo"), "hi")
    ids = means.select("itemid").distinct().withColumn("cycle", of(F.col("itemid")))
    grid = ids.join(F.broadcast(ends), "cycle").select("itemid", F.explode(F.sequence("lo", "hi")).alias("bucket"))  # ends: a row for each cycle
    return linear_fill(grid.join(means, ["itemid", "bucket"], "left"))


def _series(charts: DataFrame, n_buckets: int, keys: DataFrame | None = None, onsets: DataFrame | None = None, cycle: Cycle | None = None) -> DataFrame:
    """(itemid, c, d, l, f, o): each item's cycle, twice the ranks (to 9 digits) of its first differences (of levels on a grid of fewer
    than 3 buckets) and of its levels, in the order of buckets and null for flat ones, its key family and its onset."""
    along = Window.partitionBy("itemid").orderBy("bucket")
    change = F.col("value") - F.lag("value").over(along) if n_buckets >= 3 else F.col("value")
    rows = charts.select("itemid", "bucket", F.round(change, 9).alias("d"), F.round("value", 9).alias("l"))

    def ranks(c: str) -> Column:
        w = Window.partitionBy("itemid")
        twice = 2 * F.rank().over(w.orderBy(F.col(c).asc_nulls_last())) + F.count("*").over(Window.partitionBy("itemid", c)) - 1
        return F.when(F.col(c).isNotNull(), F.struct("bucket", twice.cast("int").alias("r")))

    whole = lambda c: F.when(F.max(c) > F.min(c), F.transform(F.array_sort(F.collect_list(f"_{c}")), lambda x: x["r"]))
    wanted = ["d", "l"] if keys is not None else ["d"]
    rows = rows.select("*", *(ranks(c).alias(f"_{c}") for c in wanted)).groupBy("itemid").agg(*(whole(c).alias(c) for c in wanted))
    rows = rows.withColumn("c", (cycle or (lambda _: F.lit(0)))(F.col("itemid")).cast("long"))
    rows = rows.withColumns({"l": F.lit(None).cast("array<int>"), "f": F.lit(None).cast("string")}) if keys is None else rows.join(_families(keys), "itemid", "left")
    rows = rows.withColumn("o", F.lit(None).cast("long")) if onsets is None else rows.join(onsets.select("itemid", F.col("onset").cast("long").alias("o")), "itemid", "left")
    return materialize(rows.select("itemid", "c", "d", F.when(F.col("f").isNotNull(), F.col("l")).alias("l"), "f", "o"), "series")


#: Items of a block of the correlation matrix; of many items, and the most blocks in a row before blocks grow to these.
BLOCK, LARGE_BLOCK, IN_A_ROW = 256, 1024, 16
#: Ranks of a block at most, and tasks that blocks are dealt to.
BLOCK_RANKS, MOST_TASKS = 1 << 23, 2000


def _centred(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Twice the ranks less their mean, which are whole numbers, and the sums of their squares."""
    x = 2.0 * np.stack(vectors.to_numpy())
    x -= x.mean(axis=1, keepdims=True)
    return x, (x * x).sum(axis=1)


def _rho(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Correlations: the sums are exact below 2**53, so a threshold is met by what equals it, in any block and order."""
    out, scale = left[0] @ right[0].T, left[1][:, None] * right[1][None, :]
    return np.divide(out, np.sqrt(scale, out=scale), out=out)


def _standard(vectors: pd.Series) -> np.ndarray:
    """Ranks as vectors of mean 0 and length 1: a correlation is their product, and 2 - 2 rho the square of their distance."""
    x, square = _centred(vectors)
    return x / np.sqrt(square)[:, None]


def _vectors(ranks: DataFrame, family: DataFrame | None) -> DataFrame:
    """(itemid, v, f): each item's ranks in the order of buckets, and its family."""
    vectors = ranks.groupBy("itemid").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "r"))), lambda x: x["r"].cast("double")).alias("v"))
    return materialize(vectors.withColumn("f", F.lit("")) if family is None else vectors.join(family, "itemid"), "rank-vectors")


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """`rows`, each in the blocks (a, b) of the matrix of its `key` that hold it, with g, its own part.
    What is shuffled grows with rows times blocks, not with pairs, and no block is more than a task's work."""
    vector = "d" if "d" in rows.columns else "v"
    n, size = F.count("*"), F.max(F.coalesce(F.size(vector), F.lit(1)))
    most = F.greatest(F.lit(1), F.least(F.lit(LARGE_BLOCK), F.floor(BLOCK_RANKS / F.greatest(size, F.lit(1)))))
    parts = F.greatest(F.least(F.ceil(n / BLOCK), F.lit(IN_A_ROW)), F.ceil(n / most))
    sizes = materialize(rows.groupBy(key).agg(parts.cast("int").alias("parts")), "blocks")
    total = sizes.agg(F.sum(F.col("parts") * (F.col("parts") + 1) / 2)).first()[0] or 1
    dealt = rows.join(sizes, key).withColumn("g", F.pmod(F.xxhash64("itemid"), F.col("parts")).cast("int"))
    sent = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"a": F.least("g", "k"), "b": F.greatest("g", "k")}).drop("parts", "k")
    # by number, or Spark would put the blocks, small before they are multiplied, together
    return sent.repartition(int(min(max(total, 1), MOST_TASKS)), key, "a", "b")


def _sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The items of both sides of a block; of one on the diagonal the same ones, in their order."""
    rows = rows.sort_values("itemid")
    a, b = rows["a"].iloc[0], rows["b"].iloc[0]
    return (rows, rows) if a == b else (rows[rows["g"] == a], rows[rows["g"] == b])


def _pairs(left: pd.DataFrame, right: pd.DataFrame, wanted: np.ndarray, **values: np.ndarray) -> pd.DataFrame:
    """The `wanted` pairs, the lower item first."""
    if left is right:
        wanted = np.triu(wanted, 1)
    i, j = np.nonzero(wanted)
    x, y = left["itemid"].to_numpy()[i], right["itemid"].to_numpy()[j]
    return pd.DataFrame({"i": np.minimum(x, y), "j": np.maximum(x, y)} | {k: v[i, j] for k, v in values.items()})


def _matrix(vectors: DataFrame, least: float) -> DataFrame:
    """(i, j, rho) of the pairs i < j of vectors of one `f` whose rho is `least` or more."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(rows)
        if not len(left) or not len(right):
            return pd.DataFrame({"i": [], "j": [], "rho": []})
        rho = _rho(_centred(left["v"]), _centred(right["v"]))
        return _pairs(left, right, rho >= least - _SLACK, rho=rho)

    return _blocks(vectors, "f").groupBy("f", "a", "b").applyInPandas(block, "i long, j long, rho double")


class _Side(NamedTuple):
    """Series of one side of a block: centred ranks of differences (zero for flat ones) and of levels, number of the family (-1 for
    none, and where levels are flat) and onset."""

    d: tuple[np.ndarray, np.ndarray]
    l: tuple[np.ndarray, np.ndarray]  # noqa: E741
    f: np.ndarray
    o: np.ndarray

    def part(self, at: slice | np.ndarray) -> _Side:
        return _Side((self.d[0][at], self.d[1][at]), (self.l[0][at], self.l[1][at]), self.f[at], self.o[at])


def _whole_side(rows: pd.DataFrame) -> _Side:
    """A block's rows, to be taken apart by part(); their series are of one length."""

    def ranks(column: str) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(rows[column].notna())
        if not len(at):
            return np.zeros((len(rows), 1)), np.ones(len(rows))
        x, square = _centred(rows[column].iloc[at])
        out, squares = np.zeros((len(rows), x.shape[1])), np.ones(len(rows))
        out[at], squares[at] = x, square
        return out, squares

    family = np.where(rows["l"].notna(), pd.factorize(rows["f"])[0], -1)
    return _Side(ranks("d"), ranks("l"), family, rows["o"].to_numpy(float))


def _between(left: _Side, right: _Side, raw_corr_min: float, max_gap: int) -> np.ndarray:
    """Distances of all pairs of two sides, as pair_distances() has them."""
    halved = lambda rho: np.multiply(np.subtract(1, rho, out=rho), 0.5, out=rho)
    distance = halved(_rho(left.d, right.d))
    for f in np.intersect1d(left.f, right.f):
        if f >= 0:
            x, y = np.flatnonzero(left.f == f), np.flatnonzero(right.f == f)
            raw, at = _rho(left.part(x).l, right.part(y).l), np.ix_(x, y)
            far = raw < raw_corr_min
            raw = halved(raw)
            raw[far] = np.inf
            distance[at] = np.minimum(distance[at], raw)
    if max_gap > 0:
        distance[np.abs(left.o[:, None] - right.o[None, :]) > max_gap] = 1.0
    return distance


def _distances(series: DataFrame, raw_corr_min: float, max_gap: int = 0, eps: float | None = None, at: bool = False) -> DataFrame:
    """(i, j, distance) of the pairs i < j of series of one cycle, as pair_distances() has them; those below `eps` only, if given (or
    `at` it). Both correlations and the onsets of a pair meet in its block, so no pair is shuffled."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("itemid", ignore_index=True)
        left, right = _sides(rows)
        whole = _whole_side(rows)
        distance = _between(whole.part(left.index.to_numpy()), whole.part(right.index.to_numpy()), raw_corr_min, max_gap)
        wanted = np.ones(distance.shape, bool) if eps is None else distance <= eps if at else distance < eps
        return _pairs(left, right, wanted, distance=distance)

    return _blocks(series, "c").groupBy("c", "a", "b").applyInPandas(block, "i long, j long, distance double")


#: Most pivots of the metric index, vectors that they are chosen from, and bytes of these.
PIVOTS, SAMPLE, SAMPLE_BYTES = 64, 512, 64 << 20
#: Items for each pivot.
CELL = 64
_SLACK = 1e-6


def _pivots(vectors: DataFrame) -> np.ndarray:
    """Vectors far from each other, of a bounded sample."""
    n, length = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    most = int(min(SAMPLE, n, max(SAMPLE_BYTES // (8 * (length or 1)), 1)))
    rows = vectors.orderBy(F.xxhash64("itemid"), "itemid").limit(most).select("v").toPandas()
    if not len(rows):
        return np.zeros((0, 0))
    x = _standard(rows["v"])
    chosen, away = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(PIVOTS, n // CELL) and away.max() > _SLACK:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def index_blocks(vectors: DataFrame, least: float, pivots: np.ndarray) -> DataFrame:
    """(itemid, f, a, b, own): the blocks (a, b) that an item is compared in, so that two items of one `f` with correlation
    `least` or more share one block, and `own`, whether it stands on the side of a.

    Every item belongs to the cell of its nearest pivot, at a distance h from the plane between that and another pivot. Items
    of two cells are apart by both their h at least, so an item goes only to cells whose smallest h leaves room for a
    close one. A cell is cut to parts of BLOCK items, so no cell is a task's work.
    """
    radius = float(np.sqrt(max(2 - 2 * least, 0.0))) + _SLACK

    def deal(batches):
        apart = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2), 1e-300))
        for rows in batches:
            if len(rows):
                square = 2 - 2 * (_standard(rows["v"]) @ pivots.T)
                cell = square.argmin(axis=1)
                h = (square - square[np.arange(len(cell)), cell][:, None]) / (2 * apart[cell])
                yield pd.DataFrame({"itemid": rows["itemid"], "f": rows["f"], "cell": cell, "h": list(h)})

    dealt = materialize(vectors.select("itemid", "f", "v").mapInPandas(deal, "itemid long, f string, cell int, h array<double>"), "rank-cells")
    sizes = dealt.groupBy("f", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    margin = dealt.select("cell", F.posexplode("h").alias("b", "h")).groupBy("cell", "b").agg(F.min("h").alias("m"))
    # a row for each pair of pivots
    near = F.broadcast(margin.select(F.col("cell").alias("b"), F.col("b").alias("cell"), "m"))
    mine = dealt.join(sizes, ["f", "cell"]).withColumn("g", F.pmod(F.xxhash64("itemid"), F.col("n")).cast("int")).select("itemid", "f", "cell", "g", F.posexplode("h").alias("b", "h"))
    sent = mine.join(near, ["cell", "b"]).where((F.col("b") == F.col("cell")) | (F.col("h") + F.col("m") < radius))
    sent = sent.join(sizes.select("f", F.col("cell").alias("b"), "n"), ["f", "b"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    here, there = F.struct(F.col("cell").alias("c"), F.col("g").alias("g")), F.struct(F.col("b").alias("c"), F.col("k").alias("g"))
    return sent.select("itemid", "f", F.least(here, there).alias("a"), F.greatest(here, there).alias("b"), (here <= there).alias("own"))


def close_correlation(ranks: DataFrame, least: float, family: DataFrame | None = None) -> DataFrame:
    """(i, j, rho) of the pairs i < j of items (with `family` (itemid, f), of one family) whose rho is `least` or more; all series have
    one length."""
    return _close_vectors(_vectors(ranks, family), least)


def _close_vectors(vectors: DataFrame, least: float) -> DataFrame:
    pivots, near = _pivots(vectors), F.round("rho", 12) >= F.lit(least - 1e-12)
    if len(pivots) < 2:  # one cell: the whole matrix
        return _matrix(vectors, least).where(near)

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        (x, square), ids, own = _centred(rows["v"]), rows["itemid"].to_numpy(), rows["own"].to_numpy()
        left, right = (slice(None), slice(None)) if own.all() else (own, ~own)
        i, j = np.nonzero((rho := _rho((x[left], square[left]), (x[right], square[right]))) >= least - _SLACK)
        out = pd.DataFrame({"i": ids[left][i], "j": ids[right][j], "rho": rho[i, j]})
        if own.all():
            return out[out["i"] < out["j"]]
        return pd.DataFrame({"i": np.minimum(out["i"], out["j"]), "j": np.maximum(out["i"], out["j"]), "rho": out["rho"]})

    found = index_blocks(vectors, least, pivots).join(vectors.select("itemid", "v"), "itemid")
    return found.groupBy("f", "a", "b").applyInPandas(block, "i long, j long, rho double").where(near)


def _families(keys: DataFrame) -> DataFrame:
    return keys.select("itemid", key_family(F.col("key_")).alias("f")).where("f <> ''")


#: Two unrelated series are at 0.5; an index for an `eps` not far below keeps few of them apart.
LOOSE = 0.4


def close_pairs(charts: DataFrame, eps: float, keys: DataFrame | None = None, raw_corr_min: float = 0.99, n_buckets: int = 3, at: bool = False, cycle: Cycle | None = None) -> DataFrame:
    """The rows of pair_distances() whose distance is less than `eps` (or `at` it), for an `eps` of 0.5 at most: flat series are
    close to none. Grids of several cycles differ in length and are compared by blocks, within cycles."""
    return _close(_series(charts, n_buckets, keys, cycle=cycle), eps, raw_corr_min, at, keys is not None, cycle is not None)


def _close(series: DataFrame, eps: float, raw_corr_min: float, at: bool, raw: bool, cycles: bool) -> DataFrame:
    if cycles or eps >= LOOSE:
        return _distances(series, raw_corr_min, eps=eps, at=at)
    of = lambda c, f: materialize(series.where(F.col(c).isNotNull()).select("itemid", F.col(c).alias("v"), f.alias("f")), "rank-vectors")
    near = lambda rho: rho.select("i", "j", ((1 - F.col("rho")) / 2).alias("distance"))
    out = near(_close_vectors(of("d", F.lit("")), 1 - 2 * eps))
    if raw:
        levels = _close_vectors(of("l", F.col("f")), max(raw_corr_min, 1 - 2 * eps)).where(F.col("rho") >= raw_corr_min)
        out = out.unionByName(near(levels)).groupBy("i", "j").agg(F.min("distance").alias("distance"))
    return out.where(F.col("distance") <= eps if at else F.col("distance") < eps)


def pair_distances(charts: DataFrame, keys: DataFrame | None = None, raw_corr_min: float = 0.99, n_buckets: int = 3, cycle: Cycle | None = None, onsets: DataFrame | None = None, max_gap: int = 0) -> DataFrame:
    """(i, j, distance) of all pairs i < j of charted items (of one cycle): (1 - rho) / 2 of their differences (of levels on a grid of
    fewer than 3 buckets); of items of one key family whose levels correlate at `raw_corr_min` or more, that of the levels if smaller.
    Flat series have rho 0. With `onsets`, as onset_constraint() has it."""
    return _distances(_series(charts, n_buckets, keys, onsets if max_gap > 0 else None, cycle), raw_corr_min, max_gap)


def _classes(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(itemid, c, d, l, f, o, n), one series of those that all distances are the same of, the lowest item's, with their number; and
    (itemid, lead), which it is of each item. Items of a class are at distance 0, which a linkage merges first, lowest items first;
    so it merges classes as it would merge items. Flat series aren't near each other unless their levels are: each is a class."""
    alone = F.when(F.col("d").isNull() & F.col("l").isNull(), F.col("itemid"))
    series = series.withColumn("s", alone)
    same = ["c", "d", "l", "f", "o", "s"]
    classes = materialize(series.groupBy(*same).agg(F.min("itemid").alias("itemid"), F.count("*").alias("n")), "series-classes")
    lead = classes.select(F.col("itemid").alias("lead"), *(F.col(c).alias(f"_{c}") for c in same))
    match = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same))
    return classes.drop("s"), materialize(series.join(lead, match).select("itemid", "lead"), "series-leads")


def onset_constraint(distances: DataFrame, onsets: DataFrame, max_gap: int) -> DataFrame:
    """Pairs whose known onsets lie more than `max_gap` apart are at distance 1."""
    if max_gap <= 0:
        return distances
    o = lambda side: onsets.select(F.col("itemid").alias(side), F.col("onset").alias(f"o{side}"))
    j = distances.join(o("i"), "i", "left").join(o("j"), "j", "left")
    return j.select("i", "j", F.when(F.abs(F.col("oi") - F.col("oj")) > max_gap, 1.0).otherwise(F.col("distance")).alias("distance"))


def agglomerate(d: np.ndarray, eps: float, linkage: str, items: np.ndarray | None = None) -> np.ndarray:
    """Group of each row: merges the closest two groups while they are closer than `eps`; ties to the lowest rows. A row may stand for
    several `items` at distance 0.

    Every row keeps its closest later row, so a merge costs one pass over the rows, but for those whose closest went.
    """
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n) if items is None else items.astype(float), np.arange(n)
    later = np.where(np.triu(np.ones((n, n), bool), 1), d, np.inf)
    near = later.argmin(axis=1)
    best = later[np.arange(n), near]
    for _ in range(n - 1):
        a = int(np.argmin(best))
        if not best[a] < eps:
            break
        b = int(near[a])
        row = np.maximum(d[a], d[b]) if linkage == "complete" else (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        row[[a, b]] = np.inf
        d[a, :] = d[:, a] = row
        d[b, :] = d[:, b] = np.inf
        later[:a, a], later[a, a + 1 :] = row[:a], row[a + 1 :]
        later[b, :] = later[:, b] = np.inf
        size[a] += size[b]
        label[label == b] = a
        again = np.flatnonzero((near == a) | (near == b))
        again = np.unique(np.append(again, [a, b]))
        near[again] = later[again].argmin(axis=1)
        best[again] = later[again, near[again]]
        closer = np.flatnonzero((row[:a] < best[:a]) | ((row[:a] == best[:a]) & (a < near[:a]) & np.isfinite(row[:a])))
        near[closer], best[closer] = a, row[closer]
    return label


def density(d: np.ndarray, eps: float, min_samples: int, items: np.ndarray | None = None) -> np.ndarray:
    """DBSCAN on distances: -1 for noise. A row is a neighbour of itself; the border belongs to the first cluster that reaches it. A row
    may stand for several `items`."""
    near = d <= eps
    np.fill_diagonal(near, True)
    core = near @ (np.ones(len(d)) if items is None else items) >= min_samples
    label = np.full(len(d), -1)
    for s in np.flatnonzero(core):
        if label[s] >= 0:
            continue
        label[s], todo = s, [s]
        while todo:
            for x in np.flatnonzero(near[todo.pop()] & (label < 0)):
                label[x] = s
                if core[x]:
                    todo.append(x)
    return label


def link_rounds(pairs: DataFrame) -> DataFrame:
    """(itemid, lead): complete linkage of close pairs (i, j, distance) in rounds, lead being the lowest item of a group; pairs
    that aren't listed are never merged across.

    In each round all groups that are each other's nearest merge at once. Pairs are ordered by distance, then by their
    leads, and merging two groups brings none nearer to a third, so this is what merging the nearest two at a time gives.
    """
    table = materialize(pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.coalesce("distance", F.lit(1.0)).alias("d")), "linkage")
    ends = table.select(F.col("a").alias("itemid")).unionByName(table.select(F.col("b").alias("itemid"))).distinct()
    table = table.where("a <> b")
    label = materialize(ends.select("itemid", F.col("itemid").alias("lead")), "linkage-labels")
    while True:
        key = F.struct("d", "a", "b").alias("key")
        sides = table.select(F.col("a").alias("x"), key).unionByName(table.select(F.col("b").alias("x"), key))
        nearest = sides.groupBy("x").agg(F.min("key").alias("key"))
        both = nearest.groupBy("key").agg(F.count("*").alias("n")).where("n = 2")
        merged = materialize(both.select(F.col("key.b").alias("gone"), F.col("key.a").alias("into")), "linkage-merged")
        if not merged.limit(1).count():
            return label
        label = materialize(label.join(merged, F.col("lead") == F.col("gone"), "left").select("itemid", F.coalesce("into", "lead").alias("lead")), "linkage-labels")
        parts = merged.select(F.col("into").alias("p")).withColumn("parts", F.lit(2))
        moved = table.join(merged.select(F.col("gone").alias("a"), F.col("into").alias("na")), "a", "left").join(merged.select(F.col("gone").alias("b"), F.col("into").alias("nb")), "b", "left")
        moved = moved.select(F.coalesce("na", "a").alias("x"), F.coalesce("nb", "b").alias("y"), "d").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d")
        joint = moved.groupBy("a", "b").agg(F.max("d").alias("d"), F.count("*").alias("n"))
        size = lambda c: parts.select(F.col("p").alias(c), F.col("parts").alias(f"n{c}"))
        # two groups are close if all their halves are
        whole = joint.join(size("a"), "a", "left").join(size("b"), "b", "left").where(F.col("n") == F.coalesce("na", F.lit(1)) * F.coalesce("nb", F.lit(1)))
        table = materialize(whole.select("a", "b", "d"), "linkage")


#: Items of a side of a block of groups at most, the most sides in a row before they grow to these, rows and columns of a piece of a
#: block's matrix, and tasks that the blocks are dealt to.
GROUPS_BLOCK, GROUPS_IN_A_ROW, PIECE, GROUPS_TASKS = 2048, 8, 512, 240


def _runs_max(d: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The maximum of the rows of each group, which lie together."""
    first = np.flatnonzero(np.diff(of, prepend=-1))
    if len(first) == len(of):
        return d
    d = np.ascontiguousarray(d)
    size, out = np.diff(first, append=len(of)), d[first]
    for k in range(1, size.max()):
        more = np.flatnonzero(size > k)
        out[more] = np.maximum(out[more], d[first[more] + k])
    return out


def _furthest(left: _Side, right: _Side, x: np.ndarray, y: np.ndarray, raw_corr_min: float, max_gap: int) -> np.ndarray:
    """Complete linkage's distances of groups, from the sides' items in the order of their groups' numbers `x` and `y` from 0."""
    out = np.full((x[-1] + 1, y[-1] + 1), -np.inf)
    for s in range(0, len(x), PIECE):
        for t in range(0, len(y), PIECE):
            m, n = x[s : s + PIECE], y[t : t + PIECE]
            d = _between(left.part(slice(s, s + PIECE)), right.part(slice(t, t + PIECE)), raw_corr_min, max_gap)
            d = _runs_max(_runs_max(d, m).T, n).T
            here = out[m[0] : m[-1] + 1, n[0] : n[-1] + 1]
            np.maximum(here, d, out=here)
    return out


def _group_pairs(members: DataFrame, eps: float, raw_corr_min: float, max_gap: int, nearest: bool) -> DataFrame:
    """(x, y, distance, close) of groups of one cycle closer than `eps`: `nearest` gives that of each open group (ties to the lowest y), and how
    many are close to it, else all pairs x < y. `members` (lead, open, with the columns of _series()) are the items of the groups. A group's items are in one block's side, and
    what is shuffled grows with items times blocks; distances never leave their block."""
    size = F.max(F.coalesce(F.size("d"), F.size("l"), F.lit(1)))
    most = F.greatest(F.lit(1), F.least(F.lit(GROUPS_BLOCK), F.floor(BLOCK_RANKS / F.greatest(size, F.lit(1)))))
    parts = lambda n: F.greatest(F.least(F.ceil(n / BLOCK), F.lit(GROUPS_IN_A_ROW)), F.ceil(n / most), F.lit(1)).cast("int")
    sizes = materialize(members.groupBy("c").agg(parts(F.count_if("open")).alias("p"), parts(F.count("*")).alias("q")), "blocks")
    total = sizes.agg(F.sum(F.col("p") * F.col("q"))).first()[0] or 1
    part, every = lambda n: F.pmod(F.xxhash64("lead"), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = members.join(sizes, "c")
    mine = sent.where("open").withColumns({"a": part("p"), "own": F.lit(True)}).withColumn("b", every("q"))
    others = sent.withColumns({"b": part("q"), "own": F.lit(False)}).withColumn("a", every("p"))
    dealt = mine.unionByName(others).select("c", "a", "b", "own", "lead", "d", "l", "f", "o")

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lead", ignore_index=True)
        whole, own, lead = _whole_side(rows), rows["own"].to_numpy(bool), rows["lead"].to_numpy()
        if own.all() or not own.any():
            return pd.DataFrame({"x": [], "y": [], "distance": [], "close": []})
        (i, m), (j, n) = (np.unique(lead[side], return_inverse=True) for side in (own, ~own))
        d = _furthest(whole.part(own), whole.part(~own), m, n, raw_corr_min, max_gap)
        if not nearest:
            m, n = np.nonzero((d < eps) & (i[:, None] < j[None, :]))
            close = np.ones(len(m), int)
        else:
            d[i[:, None] == j[None, :]] = np.inf
            close = (d < eps).sum(axis=1)
            m, n = np.arange(len(i)), d.argmin(axis=1)
            m, n, close = m[close > 0], n[close > 0], close[close > 0]
        return pd.DataFrame({"x": i[m], "y": j[n], "distance": d[m, n], "close": close})

    # by number, or Spark would put the blocks together
    found = dealt.repartition(int(min(total, GROUPS_TASKS)), "c", "a", "b").groupBy("c", "a", "b").applyInPandas(block, "x long, y long, distance double, close long")
    if not nearest:
        return found
    return found.groupBy("x").agg(F.min(F.struct("distance", "y")).alias("k"), F.sum("close").alias("close")).select("x", "k.y", "k.distance", "close")


def link_series(series: DataFrame, eps: float, raw_corr_min: float, max_gap: int = 0, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(itemid, lead), complete linkage of `series` as link_rounds() has it, until at most `most` groups have a group closer than `eps`,
    or there are no more such pairs than `most` groups have; and (i, j, distance), the close pairs of these. No pair is written before: a round computes distances from the series, for those groups alone
    that merged or whose nearest did. Every other group's nearest stays, as merging brings no group nearer to a third."""
    members = series.select("itemid", "c", "d", "l", "f", "o", F.col("itemid").alias("lead"), F.lit(True).alias("open"), F.lit(True).alias("live"))
    near = None
    while True:
        found = _group_pairs(members.where("live"), eps, raw_corr_min, max_gap, True)
        near = materialize(found if near is None else near.unionByName(found), "link-nearest")
        pair = near.select(F.least("x", "y").alias("into"), F.greatest("x", "y").alias("gone"), "distance")
        merged = materialize(pair.groupBy("into", "gone").agg(F.count("*").alias("n")).where("n = 2").select("into", "gone"), "link-merged")
        n, pairs = near.agg(F.count("*"), F.coalesce(F.sum("close"), F.lit(0)) / 2).first()
        n_merged = merged.count()
        if n and not n_merged:  # sums too large to be exact
            merged, n_merged = materialize(pair.orderBy("distance", "into", "gone").limit(1).select("into", "gone"), "link-merged"), 1
        ends = merged.select(F.col("gone").alias("x"), "into").unionByName(merged.select(F.col("into").alias("x"), "into"))
        moved = near.join(ends, "x", "left").join(ends.select(F.col("x").alias("y"), F.lit(True).alias("went")), "y", "left")
        moved = materialize(moved.select("x", "y", "distance", "close", F.coalesce("into", "x").alias("lead"), (F.col("into").isNotNull() | F.col("went").isNotNull()).alias("open")), "link-moved")
        to = moved.select(F.col("x").alias("lead"), F.col("lead").alias("_lead"), F.col("open").alias("_open"))
        members = members.drop("open", "live").join(to, "lead", "left").withColumns({"open": F.coalesce("_open", F.lit(False)), "live": F.col("_lead").isNotNull(), "lead": F.coalesce("_lead", "lead")})
        members = materialize(members.drop("_lead", "_open"), "link-members")
        # a group never gets more close ones, so there are no more pairs than counted before
        if n - n_merged <= most or pairs <= most * (most - 1) / 2:
            last = members.where("live").withColumn("open", F.lit(True))
            return members.select("itemid", "lead"), _group_pairs(last, eps, raw_corr_min, max_gap, False).select(F.col("x").alias("i"), F.col("y").alias("j"), "distance")
        near = moved.where("not open").select("x", "y", "distance", "close")


def density_rounds(pairs: DataFrame, min_samples: int, items: DataFrame | None = None) -> DataFrame:
    """(itemid, lead) of density() over close pairs (i, j) as tables: core items by connected components, border items by the
    lowest core of a neighbouring cluster; noise has no row. `items` (itemid, n) are rows that stand for several."""
    sides = materialize(pairs.select(F.col("i").alias("x"), F.col("j").alias("y")).unionByName(pairs.select(F.col("j").alias("x"), F.col("i").alias("y"))).distinct(), "density-sides")
    # with the row itself once
    near = sides.where("x <> y").unionByName(sides.select("x", F.col("x").alias("y")).distinct())
    near = near.withColumn("n", F.lit(1)) if items is None else near.join(items.withColumnRenamed("itemid", "y"), "y", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    core = materialize(near.groupBy("x").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("x"), "density-core")
    from_core = sides.join(core, "x", "left_semi")
    linked = from_core.join(core.select(F.col("x").alias("y")), "y", "left_semi").select(F.col("x").alias("a"), F.col("y").alias("b"))
    start = materialize(core.join(components(linked).withColumnRenamed("s", "x"), "x", "left").select("x", F.coalesce("root", "x").alias("start")), "density-starts")
    border = from_core.join(core.select(F.col("x").alias("y")), "y", "left_anti").join(start, "x").groupBy(F.col("y").alias("x")).agg(F.min("start").alias("start"))
    found = materialize(start.unionByName(border), "density-found")
    return found.join(found.groupBy("start").agg(F.min("x").alias("lead")), "start").select(F.col("x").alias("itemid"), "lead")


def group_items(distances: DataFrame, cfg: Clustering, ids: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """(itemid, clusterid) of every item of `ids` (of a pair, if not given): clusters are numbered by their lowest itemid, -1 is
    none. Average linkage needs all pairs, for the others those that aren't close may be missing.

    No linkage joins items that no chain of close pairs connects, so each connected component of the close pairs is a
    task of its own; beyond `max_items` items it is linked in rounds, for average linkage it is an error. `items` (itemid, n) are rows
    that stand for several items at distance 0, see _classes().
    """
    if items is not None:  # these are close to themselves
        items = items.where("n > 1")
        distances = distances.unionByName(items.select(F.col("itemid").alias("i"), F.col("itemid").alias("j"), F.lit(0.0).alias("distance")))
    distances = materialize(distances, "pair-distances")
    close = distances.where(F.col("distance") <= cfg.corr_eps if cfg.linkage == "dbscan" else F.col("distance") < cfg.corr_eps)
    edges = close.select(F.col("i").alias("a"), F.col("j").alias("b"))
    ends = edges.select(F.col("a").alias("itemid")).unionByName(edges.select(F.col("b").alias("itemid"))).distinct()
    root = materialize(ends.join(components(edges).withColumnRenamed("s", "itemid"), "itemid", "left").select("itemid", F.coalesce("root", "itemid").alias("root")), "incident-roots")
    large = materialize(root.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > cfg.max_items).select("root"), "incident-large")
    rounds = cfg.linkage != "average" and large.limit(1).count() > 0
    side = lambda c: root.select(F.col("itemid").alias(c), F.col("root").alias(f"r{c}"))
    within = distances.join(side("i"), "i").join(side("j"), "j").where("ri = rj") if cfg.linkage == "average" else close.join(side("i"), "i")
    several = lambda c: F.lit(1) if items is None else F.coalesce(c, F.lit(1))
    if items is not None:
        for c in ("i", "j"):
            within = within.join(items.select(F.col("itemid").alias(c), F.col("n").alias(f"n{c}")), c, "left")
    within = within.withColumns({"ni": several("ni"), "nj": several("nj")})

    def link(pairs: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pairs[["i", "j"]].to_numpy())
        if len(ids) > cfg.max_items:
            raise ValueError(f"{len(ids)} items to cluster; max_items is {cfg.max_items}")
        d = np.full((len(ids), len(ids)), np.inf)
        np.fill_diagonal(d, 0)
        i, j = np.searchsorted(ids, pairs["i"]), np.searchsorted(ids, pairs["j"])
        d[i, j] = d[j, i] = pairs["distance"].fillna(1.0)
        size = np.ones(len(ids), int)
        size[i], size[j] = pairs["ni"], pairs["nj"]
        label = density(d, cfg.corr_eps, cfg.min_samples, size) if cfg.linkage == "dbscan" else agglomerate(d, cfg.corr_eps, cfg.linkage, size)
        count = np.bincount(label + 1, size, minlength=len(ids) + 1)
        some = label >= 0 if cfg.linkage == "dbscan" else count[label + 1] >= cfg.min_samples
        lowest = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(lowest, label[some], ids[some])
        return pd.DataFrame({"itemid": ids[some], "lead": lowest[label[some]]})

    big = large.withColumnRenamed("root", "ri")
    found = (within.join(big, "ri", "left_anti") if rounds else within).groupBy("ri").applyInPandas(link, "itemid long, lead long")
    if rounds:
        rest = within.join(big, "ri", "left_semi")
        linked = density_rounds(rest, cfg.min_samples, items) if cfg.linkage == "dbscan" else link_rounds(rest)
        if cfg.linkage != "dbscan":
            counted = linked if items is None else linked.join(items, "itemid", "left")
            linked = linked.join(counted.groupBy("lead").agg(F.sum(several("n")).alias("n")).where(F.col("n") >= cfg.min_samples).select("lead"), "lead", "left_semi").select("itemid", "lead")
        found = found.unionByName(linked)
    found = materialize(found, "incident-groups")
    # a row for each incident: a short sort
    number = found.select("lead").distinct().withColumn("clusterid", F.row_number().over(Window.orderBy("lead")) - 1)
    if ids is None:
        ids = distances.select(F.col("i").alias("itemid")).unionByName(distances.select(F.col("j").alias("itemid"))).distinct()
    return ids.join(found.join(number, "lead"), "itemid", "left").select("itemid", F.coalesce("clusterid", F.lit(-1)).cast("int").alias("clusterid"))


def cluster_anomalies(history: DataFrame, ids: DataFrame, cfg: Clustering, keys: DataFrame | None = None, onsets: DataFrame | None = None, cycle: Cycle | None = None) -> DataFrame:
    """(itemid, clusterid) of the items of `ids`; -1 for all (of a cycle) if there is too little to correlate."""
    of = cycle or (lambda _: F.lit(0))
    rows = materialize(history.join(ids.select("itemid").distinct(), "itemid", "left_semi"), "flagged-samples")
    unit = materialize(grid_unit(rows) if cycle is None else cycle_units(rows, cycle), "grid-unit")
    charts = materialize(build_charts(rows.join(usable_items(rows, unit, cycle), "itemid", "left_semi"), unit, cycle), "charts")
    # a row for each cycle
    shapes = charts.groupBy(of(F.col("itemid")).alias("cycle")).agg(F.count_distinct("itemid").alias("items"), F.count_distinct("bucket").alias("buckets")).collect()
    enough = [s for s in shapes if s["items"] >= 2 and s["buckets"] - (s["buckets"] >= 3) >= cfg.min_corr_points]
    constrained = onsets if onsets is not None and cfg.max_onset_gap > 0 else None
    distances = items = leads = None
    for n_buckets in (3, 1):
        wanted = [s["cycle"] for s in enough if (s["buckets"] >= 3) == (n_buckets >= 3)]
        if wanted:
            classes, mine = _classes(_series(charts.where(of(F.col("itemid")).isin(wanted)), n_buckets, keys, constrained, cycle))
            # the close pairs of more items at an `eps` that keeps few apart grow with the square of them
            if cfg.linkage == "complete" and cfg.corr_eps >= LOOSE and classes.groupBy("c").count().where(F.col("count") > cfg.max_items).limit(1).count():
                groups, more = link_series(classes, cfg.corr_eps, cfg.raw_corr_min, cfg.max_onset_gap if constrained is not None else 0, cfg.max_items)
                mine = materialize(mine.withColumnRenamed("lead", "of").join(groups.withColumnRenamed("itemid", "of"), "of").select("itemid", "lead"), "series-leads")
                classes = materialize(classes.select("itemid", "n").join(groups, "itemid").groupBy(F.col("lead").alias("itemid")).agg(F.sum("n").alias("n")), "series-groups")
            elif cfg.linkage == "average" or cfg.corr_eps > 0.5:
                more = _distances(classes, cfg.raw_corr_min)
            else:
                more = _close(classes, cfg.corr_eps, cfg.raw_corr_min, cfg.linkage == "dbscan", keys is not None, cycle is not None)
            both = lambda x, y: y if x is None else x.unionByName(y)
            distances, items, leads = both(distances, more), both(items, classes.select("itemid", "n")), both(leads, mine)
    if distances is None:
        return ids.select("itemid", F.lit(-1).alias("clusterid"))
    if constrained is not None:
        distances = onset_constraint(distances, constrained, cfg.max_onset_gap)
    found = group_items(distances, cfg, items.select("itemid"), items).withColumnRenamed("itemid", "lead")
    return ids.select("itemid").join(leads.join(found, "lead"), "itemid", "left").select("itemid", F.coalesce("clusterid", F.lit(-1)).alias("clusterid"))
