"""Operators along an item's samples, as window expressions: one sort by (itemid, clock) serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along(*order: str, key: str = "itemid") -> WindowSpec:
    return Window.partitionBy(key).orderBy(*(order or ("clock",)))


def newest_first(key: str = "itemid") -> WindowSpec:
    return Window.partitionBy(key).orderBy(F.col("clock").desc())


def gap(w: WindowSpec | None = None) -> Column:
    w = w or along()
    return F.col("clock") - F.lag("clock").over(w)


def trailing_mean(value: Column, secs: int, key: str = "itemid") -> Column:
    """Mean of the samples in (t - secs, t]."""
    return F.avg(value).over(along(key=key).rangeBetween(-(secs - 1), 0))


def cusum_peak(df: DataFrame, dev: Column, slack: Column) -> DataFrame:
    """(itemid, s_max): the highest two-sided CUSUM statistic.

    S_n = max(0, S_n-1 + x_n) is P_n - min(0, P_1, .., P_n) of the prefix sums P, so no step needs the last one's result.
    """
    upto = along().rowsBetween(Window.unboundedPreceding, 0)
    sums = df.select("itemid", "clock", F.sum(dev - slack).over(upto).alias("up"), F.sum(-dev - slack).over(upto).alias("down"))
    side = lambda c: F.col(c) - F.least(F.lit(0.0), F.min(c).over(upto))
    return sums.select("itemid", F.greatest(side("up"), side("down")).alias("s")).groupBy("itemid").agg(F.max("s").alias("s_max"))


def cusum_path(df: DataFrame, dev: Column, slack: Column) -> DataFrame:
    """(itemid, clock, s, s_max, onset) after each sample: the higher of both statistics, the highest so far, and the clock of the
    sample that the higher one has been above zero from (null at zero; upward, if both are as high)."""
    w = along()
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    sums = df.select("itemid", "clock", F.sum(dev - slack).over(upto).alias("pu"), F.sum(-dev - slack).over(upto).alias("pd"))
    sums = sums.select("itemid", "clock", *((F.col(p) - F.least(F.lit(0.0), F.min(p).over(upto))).alias(c) for c, p in (("up", "pu"), ("down", "pd"))))
    since = lambda c: F.coalesce(F.last(F.when(F.col(c) == 0, F.col("next")), True).over(before), F.first("clock").over(upto))
    runs = sums.withColumn("next", F.lead("clock").over(w)).select("itemid", "clock", "up", "down", since("up").alias("u"), since("down").alias("d"))
    s = F.greatest("up", "down")
    onset = F.when(s > 0, F.when(F.col("up") >= F.col("down"), F.col("u")).otherwise(F.col("d")))
    return runs.select("itemid", "clock", s.alias("s"), F.max(s).over(upto).alias("s_max"), onset.alias("onset"))


def regime_start(df: DataFrame, out: Column, tolerance: int) -> DataFrame:
    """(itemid, onset): clock of the oldest sample of the newest regime.

    From the newest sample back, a regime ends at more than `tolerance` samples in a row for which `out` holds; its start
    is the sample just newer than those. Items whose newest samples already end it are left out.
    """
    back = newest_first()
    rows = df.select("itemid", "clock", F.row_number().over(back).alias("rn"), F.coalesce(out, F.lit(False)).cast("int").alias("out"))
    by_rn = Window.partitionBy("itemid").orderBy("rn")
    rows = rows.withColumn("run", F.sum("out").over(by_rn.rowsBetween(-tolerance, 0)))
    ends = rows.withColumn("b", F.min(F.when(F.col("run") == tolerance + 1, F.col("rn"))).over(Window.partitionBy("itemid")))
    last = F.coalesce(F.col("b") - (tolerance + 1), F.max("rn").over(Window.partitionBy("itemid")))
    return ends.withColumn("at", last).where("rn = at").select("itemid", F.col("clock").alias("onset"))


def run_starts(hot: Column, w: WindowSpec | None = None) -> Column:
    """1 where a run of rows for which `hot` holds begins, else 0."""
    w = w or along()
    return (hot & ~F.coalesce(F.lag(hot).over(w), F.lit(False))).cast("int")


def longest_run(df: DataFrame, hit: Column, key: str = "itemid") -> DataFrame:
    """(key, n_out, longest): rows for which `hit` holds, and the most of them in a row."""
    w = along(key=key)
    rows = df.select(key, "clock", F.coalesce(hit, F.lit(False)).alias("hit"))
    island = F.row_number().over(w) - F.sum(F.col("hit").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("island", F.when(F.col("hit"), island)).groupBy(key, "island").agg(F.sum(F.col("hit").cast("int")).alias("n"))
    return runs.groupBy(key).agg(F.sum("n").alias("n_out"), F.max("n").alias("longest"))


def average_rank(value: str, key: str = "itemid") -> Column:
    """Rank of a value among its key's rows, ties at their mean."""
    return F.rank().over(Window.partitionBy(key).orderBy(value)) + (F.count("*").over(Window.partitionBy(key, value)) - 1) / 2


def linear_fill(df: DataFrame, key: str = "itemid", at: str = "bucket", value: str = "value") -> DataFrame:
    """Nulls between two values lie on the line between them, those before the first or after the last equal it."""
    w = Window.partitionBy(key).orderBy(at)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    where = F.when(F.col(value).isNotNull(), F.col(at))
    cols = df.select(
        "*",
        F.last(value, True).over(back).alias("_v0"), F.last(where, True).over(back).alias("_t0"),
        F.first(value, True).over(ahead).alias("_v1"), F.first(where, True).over(ahead).alias("_t1"),
    )
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(at) - F.col("_t0")) / F.nullif(F.col("_t1") - F.col("_t0"), F.lit(0))
    return cols.withColumn(value, F.coalesce(value, line, "_v0", "_v1")).drop("_v0", "_t0", "_v1", "_t1")


def keep_latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row by `order` of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
