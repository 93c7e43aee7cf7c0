"""Statistics by panes: mergeable partial statistics of each item's hours, put together to windows.

A pane holds the count, mean, sum of squared deviations and the like of an item's rows in one hour, so that windows that
overlap share it; a window takes the panes that lie in it wholly and the rows of the hours at its ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, hour_of_day
from .stats import in_range

PANE = 3600


def pane_of(clock: Column) -> Column:
    return clock - F.pmod(clock, F.lit(PANE))


def partials(rows: DataFrame, value: str = "value", low: str | None = None, high: str | None = None) -> DataFrame:
    """(itemid, pane, n, mean, m2, max_value, zero_cnt, last_clock, spread, spread_n) of rows; `low` and `high` bound a row's own
    values, and spread is the sum of their ranges."""
    x = finite(F.col(value))
    spread = F.greatest(F.col(high) - F.col(low), F.lit(0.0)) if low and high else F.lit(None).cast("double")
    g = rows.select("itemid", "clock", pane_of(F.col("clock")).alias("pane"), x.alias("x"), spread.alias("s")).groupBy("itemid", "pane")
    return g.agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.var_pop("x") * F.count("x"), F.lit(0.0)).alias("m2"), F.max("x").alias("max_value"),
        F.count_if(F.col("x") == 0).alias("zero_cnt"), F.max("clock").alias("last_clock"), F.sum("s").alias("spread"), F.count("s").alias("spread_n"),
    )


def merged(panes: DataFrame, *keys: str) -> DataFrame:
    """The partial statistics of all of a key's panes: deviations from the common mean, so that nothing cancels out."""
    total = F.sum(F.col("n") * F.col("mean")).over(Window.partitionBy(*keys)) / F.nullif(F.sum("n").over(Window.partitionBy(*keys)), F.lit(0))
    off = F.col("mean") - F.col("common")
    return panes.withColumn("common", total).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("common").alias("mean"), F.sum(F.col("m2") + F.coalesce(F.col("n") * off * off, F.lit(0.0))).alias("m2"), F.max("max_value").alias("max_value"),
        F.sum("zero_cnt").alias("zero_cnt"), F.max("last_clock").alias("last_clock"), F.sum("spread").alias("spread"), F.sum("spread_n").alias("spread_n"),
    )


def within(panes: DataFrame, rows: DataFrame, startep: int, endep: int, value: str = "value", low: str | None = None, high: str | None = None) -> DataFrame:
    """Panes that make up [startep, endep]: whole ones, and those of the rows in the hours at its ends."""
    first, last = startep + -startep % PANE, endep - (endep + 1) % PANE  # of whole hours
    ends = in_range(rows, startep, endep).where((F.col("clock") < first) | (F.col("clock") > last))
    return panes.where(F.col("pane").between(first, last)).unionByName(partials(ends, value, low, high))


def _std() -> Column:
    return F.sqrt(F.col("m2") / F.greatest(F.col("n") - 1, F.lit(1)))


def window_stats(parts: DataFrame, range_to_sigma: float = 1.0) -> DataFrame:
    """The row of stats.window_stats() and intra_std of each item, from the panes of its window."""
    m = merged(parts, "itemid").where("n > 0")
    n, mean = F.col("n"), F.col("mean")
    divisor = range_to_sigma if range_to_sigma > 0 else 1.0
    intra = F.col("spread") / F.nullif(F.col("spread_n"), F.lit(0)) / divisor
    return m.select("itemid", (n * mean).alias("sum"), (F.col("m2") + n * mean * mean).alias("sqr_sum"), n.alias("cnt"), "mean", _std().alias("std"), "last_clock", "zero_cnt", "max_value", intra.alias("intra_std"))


def hour_stats(parts: DataFrame) -> DataFrame:
    """The rows of stats.hour_stats(), from the panes of a window."""
    m = merged(parts.withColumn("hour_of_day", hour_of_day(F.col("pane")).cast("short")), "itemid", "hour_of_day").where("n > 0")
    return m.select("itemid", "hour_of_day", "mean", F.when(F.col("n") > 1, _std()).otherwise(0.0).alias("std"), F.col("n").alias("cnt"))
