"""Window, hour-of-day and peak-shape statistics. All are keyed by itemid: one exchange on it serves a whole batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import baseline_sigma, finite, hour_of_day
from ..functions.sequence import gap, newest_first, run_starts, trailing_mean


def in_range(df: DataFrame, startep: int, endep: int) -> DataFrame:
    """Both ends count."""
    return df.where(F.col("clock").between(startep, endep))


def _deviation(sqr: Column, total: Column, n: Column) -> Column:
    """Sample deviation from sums, 0 for one sample."""
    return F.sqrt(F.greatest((sqr - total * total / n) / F.greatest(n - 1, F.lit(1)), F.lit(0.0)))


def window_stats(data: DataFrame, startep: int, endep: int, value: str = "value") -> DataFrame:
    """Statistics of each item's samples in [startep, endep]; items without a value in it have no row."""
    x = finite(F.col(value))
    rows = in_range(data, startep, endep).select("itemid", "clock", x.alias("x"))
    agg = rows.groupBy("itemid").agg(
        F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sqr_sum"), F.count("x").alias("cnt"),
        F.max("clock").alias("last_clock"), F.count_if(F.col("x") == 0).alias("zero_cnt"), F.max("x").alias("max_value"),
    )
    n = F.col("cnt")
    return agg.where("cnt > 0").select("itemid", "sum", "sqr_sum", "cnt", (F.col("sum") / n).alias("mean"), _deviation(F.col("sqr_sum"), F.col("sum"), n).alias("std"), "last_clock", "zero_cnt", "max_value")


def intra_std(trends: DataFrame, range_to_sigma: float) -> DataFrame:
    """(itemid, intra_std): deviation within an hour, from the mean hourly range."""
    divisor = range_to_sigma if range_to_sigma > 0 else 1.0
    return trends.groupBy("itemid").agg((F.avg(F.greatest(F.col("value_max") - F.col("value_min"), F.lit(0.0))) / divisor).alias("intra_std"))


def hour_stats(trends: DataFrame, value: str = "value_avg", hour: Column | None = None) -> DataFrame:
    """(itemid, hour_of_day, mean, std, cnt) in UTC, or by `hour`."""
    x = finite(F.col(value))
    g = trends.select("itemid", (hour_of_day(F.col("clock")) if hour is None else hour).cast("short").alias("hour_of_day"), x.alias("x")).groupBy("itemid", "hour_of_day")
    return g.agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"), F.count("x").alias("cnt")).where("cnt > 0")


def sample_interval(history: DataFrame, fallback: int) -> DataFrame:
    """(itemid, interval): the median positive gap between samples, whole seconds and at least 1."""
    gaps = history.select("itemid", gap().alias("gap"))
    mid = gaps.groupBy("itemid").agg(F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("m"))
    return mid.select("itemid", F.greatest(F.bround(F.coalesce("m", F.lit(float(fallback))), 0).cast("long"), F.lit(1)).alias("interval"))


def median_gap(history: DataFrame) -> DataFrame:
    """(itemid, gap): the median of all gaps, zeros too; items with one sample have no row."""
    return history.select("itemid", gap().alias("gap")).where("gap is not null").groupBy("itemid").agg(F.median("gap").alias("gap"))


def _unit(fallback: int) -> Column:
    return F.when(F.col("m") >= 1, F.floor("m")).otherwise(F.lit(fallback)).cast("long").alias("unit")


def grid_unit(history: DataFrame, fallback: int = 600) -> DataFrame:
    """One row (unit): the median of the items' median gaps in whole seconds."""
    return median_gap(history).agg(F.median("gap").alias("m")).select(_unit(fallback))


def cycle_units(history: DataFrame, cycle: Callable[[Column], Column], fallback: int = 600) -> DataFrame:
    """(cycle, unit): grid_unit() of the items of each cycle."""
    return median_gap(history).groupBy(cycle(F.col("itemid")).alias("cycle")).agg(F.median("gap").alias("m")).select("cycle", _unit(fallback))


def peak_stats(trends: DataFrame, baseline: DataFrame, window_secs: int, k_sigma: float, max_clock: int | None = None, peak: str = "value_max") -> DataFrame:
    """(itemid, local_peak, peak_episodes) before `max_clock`.

    local_peak: the highest trailing mean over `window_secs` among rows with a full window behind them, or among all if
    there are none. peak_episodes: runs of rows at mean + k sigma or above; 0 without a positive sigma. `baseline` has
    itemid, mean, std, intra_std.
    """
    rows = trends if max_clock is None else trends.where(F.col("clock") < max_clock)
    rows = rows.select("itemid", "clock", finite(F.col(peak)).alias("x")).where("x is not null")
    sigma = finite(baseline_sigma(F.col("std"), F.col("intra_std")))
    joined = rows.join(baseline.select("itemid", "mean", sigma.alias("sigma")), "itemid", "left")
    hot = F.coalesce((F.col("sigma") > 0) & (F.col("x") >= F.col("mean") + k_sigma * F.col("sigma")), F.lit(False))
    marked = joined.select("itemid", "clock", trailing_mean(F.col("x"), window_secs).alias("trail"), hot.alias("hot"), (F.col("clock") - F.min("clock").over(Window.partitionBy("itemid")) >= window_secs).alias("full"))
    marked = marked.withColumn("start", run_starts(F.col("hot")))
    return marked.groupBy("itemid").agg(F.coalesce(F.max(F.when(F.col("full"), F.col("trail"))), F.max("trail")).alias("local_peak"), F.sum("start").alias("peak_episodes"))


def trend_stats(trends: DataFrame, startep: int, endep: int, range_to_sigma: float, peak_window_secs: int, k_sigma: float, exclude_recent_secs: int) -> DataFrame:
    """The whole statistics row of each item: window, within-hour and peak-shape statistics."""
    rows = in_range(trends, startep, endep)
    base = window_stats(rows, startep, endep, "value_avg").join(intra_std(rows, range_to_sigma), "itemid", "left")
    return base.join(peak_stats(rows, base, peak_window_secs, k_sigma, endep - exclude_recent_secs), "itemid", "left")


def short_window_stats(history: DataFrame, detect_window: int) -> tuple[DataFrame, DataFrame]:
    """Recent (itemid, mean) over the newest samples, and baseline (itemid, mean, std, cnt) over the rest."""
    ranked = history.select("itemid", "value", F.row_number().over(newest_first()).alias("rn")).where(F.lit(detect_window >= 1))
    recent = ranked.where(F.col("rn") <= detect_window).groupBy("itemid").agg(F.avg("value").alias("mean"))
    rest = ranked.where(F.col("rn") > detect_window).groupBy("itemid")
    return recent, rest.agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("value").alias("cnt"))


def recent_level(trends: DataFrame, samples: int, value: str = "value_avg") -> DataFrame:
    """(itemid, level): median of the newest samples."""
    ranked = trends.select("itemid", F.col(value).alias("x"), F.row_number().over(newest_first()).alias("rn"))
    return ranked.where(F.col("rn") <= max(samples, 1)).groupBy("itemid").agg(F.median("x").alias("level"))


def split_stale(stats: DataFrame, endep: int, staleness_secs: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose newest sample is recent enough, and the itemids of the others; no check if `staleness_secs` isn't positive."""
    if staleness_secs <= 0 or "last_clock" not in stats.columns:
        return stats, stats.select("itemid").limit(0)
    fresh = F.coalesce(F.col("last_clock") >= endep - staleness_secs, F.lit(False))
    return stats.where(fresh), stats.where(~fresh).select("itemid")


def hourly_trends(history: DataFrame) -> DataFrame:
    """The hourly rollup of raw samples."""
    hour = (F.col("clock") - F.pmod("clock", F.lit(3600))).alias("clock")
    return history.groupBy("itemid", hour).agg(F.min("value").alias("value_min"), F.avg("value").alias("value_avg"), F.max("value").alias("value_max"))


