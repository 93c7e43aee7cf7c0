"""When did it start: the onset of the current level, and the onset of the current anomaly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, hour_of_day
from ..functions.sequence import regime_start
from .stats import recent_level


def level_onset(trends: DataFrame, stats: DataFrame, level_tol: float = 0.1, sigma: float = 2.0, tolerance: int = 2, recent_samples: int = 3) -> DataFrame:
    """(itemid, onset): since when the item has been at its current level; unknown items have no row."""
    rows = trends.select("itemid", "clock", finite(F.col("value_avg")).alias("x")).where("x is not null")
    level = recent_level(rows, recent_samples, "x").join(stats.select("itemid", "std"), "itemid", "left")
    relative = F.lit(level_tol) * F.abs("level")
    band = F.when(relative > 0, relative).otherwise(F.lit(sigma) * F.col("std"))
    known = level.select("itemid", "level", band.alias("band")).where("band > 0")
    joined = rows.join(known, "itemid")
    return regime_start(joined, F.abs(F.col("x") - F.col("level")) > F.col("band"), tolerance)


def anomaly_onset(trends: DataFrame, stats: DataFrame, hours: DataFrame, endep: int, window_secs: int, zscore_lambda: float = 3.0, seasonal_lambda: float = 3.0, tolerance: int = 2, max_back_hours: int = 48) -> DataFrame:
    """(itemid, onset): the oldest of the hourly steps back from `endep` at which the item was already abnormal.

    At each step the mean of the window that ends there is tested like the detectors do; steps without samples, and more
    than `tolerance` normal steps in a row, end the walk. Items that are normal now have no row. Each sample is sent to
    the steps whose window holds it, so the interval join is an explode of window_secs / 3600 rows a sample.
    """
    lo = endep - 3600 * max_back_hours - window_secs
    rows = trends.where((F.col("clock") > lo) & (F.col("clock") <= endep)).select("itemid", "clock", finite(F.col("value_avg")).alias("x")).where("x is not null")
    age = F.lit(endep) - F.col("clock")
    last = F.least(F.floor(age / 3600), F.lit(max_back_hours))
    first = F.greatest(F.floor((age - window_secs) / 3600) + 1, F.lit(0))
    hits = rows.where(first <= last).select("itemid", "x", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("k"))
    means = hits.groupBy("itemid", "k").agg(F.avg("x").alias("x"))
    base = stats.select("itemid", F.col("mean").alias("t_mean"), F.col("std").alias("t_std"))
    every = rows.select("itemid").distinct().select("itemid", F.explode(F.sequence(F.lit(0), F.lit(max_back_hours))).alias("k"))
    steps = every.join(means, ["itemid", "k"], "left").withColumn("hour_of_day", hour_of_day(F.lit(endep) - F.col("k") * 3600).cast("short"))
    # an item without long-term statistics stays unknown
    steps = steps.join(base, "itemid").join(hours.select("itemid", "hour_of_day", F.col("mean").alias("s_mean"), F.col("std").alias("s_std")), ["itemid", "hour_of_day"], "left")
    test = lambda m, s, t: F.when(F.col(s) > 0, F.abs(F.col("x") - F.col(m)) / F.col(s) >= t).otherwise(False)
    hot = F.coalesce(test("t_mean", "t_std", zscore_lambda) | test("s_mean", "s_std", seasonal_lambda), F.lit(False))
    w = Window.partitionBy("itemid").orderBy("k")
    marked = steps.select("itemid", "k", "x", hot.alias("hot"))
    marked = marked.withColumn("cold", F.sum((~F.col("hot")).cast("int")).over(w.rowsBetween(-tolerance, 0)))
    marked = marked.withColumn("stopped", F.max(F.col("x").isNull() | (F.col("cold") == tolerance + 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = marked.groupBy("itemid").agg(F.max(F.when(F.col("hot") & ~F.col("stopped"), F.col("k"))).alias("k"), F.max(F.when(F.col("k") == 0, F.col("hot"))).alias("now"))
    return found.where("now").select("itemid", (F.lit(endep) - F.col("k") * 3600).cast("long").alias("onset"))
