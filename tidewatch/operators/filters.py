"""Rules that keep items from being scored, or scores from being reported."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnomalyFilter, ItemFilter, WatchRule
from ..functions.scalar import finite, matches_glob, rule_matches


def apply_item_filters(ids: DataFrame, items: DataFrame, recent: DataFrame, rules: tuple[ItemFilter, ...]) -> DataFrame:
    """Items that no rule drops; one without metadata or, for rules with a least value, without a mean stays."""
    if not rules:
        return ids
    j = ids.join(items.select("itemid", "key_", "units"), "itemid", "left").join(recent.select("itemid", finite(F.col("mean")).alias("_mean")), "itemid", "left")
    hits = [rule_matches(r, F.col("key_"), F.col("units")) & (F.lit(True) if r.min_value is None else F.col("_mean") < r.min_value) for r in rules]
    drop = F.coalesce(F.col("key_").isNotNull() & reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), hits), F.lit(False))
    return j.where(~drop).select(*ids.columns)


def apply_anomaly_filters(scores: DataFrame, items: DataFrame, recent: DataFrame, trend: DataFrame, rules: tuple[AnomalyFilter, ...]) -> DataFrame:
    """Scores whose change is large enough; a missing mean counts as 0, an item without metadata stays."""
    active = [r for r in rules if r.min_abs_diff is not None]
    if not active:
        return scores
    j = scores.join(items.select("itemid", F.col("key_").alias("_key"), F.col("units").alias("_units")), "itemid", "left")
    j = j.join(recent.select("itemid", F.col("mean").alias("_recent")), "itemid", "left").join(trend.select("itemid", F.col("mean").alias("_trend")), "itemid", "left")
    diff = F.abs(F.coalesce(finite(F.col("_recent")), F.lit(0.0)) - F.coalesce(finite(F.col("_trend")), F.lit(0.0)))
    hits = [F.coalesce(rule_matches(r, F.col("_key"), F.col("_units")), F.lit(False)) & (diff < r.min_abs_diff) for r in active]
    drop = F.col("_key").isNotNull() & reduce(lambda a, b: a | b, hits)
    return j.where(~drop).select(*scores.columns)


def watchlist(items: DataFrame, rules: tuple[WatchRule, ...]) -> DataFrame:
    """Items that any rule matches by key and host; no rules, no items. An empty pattern matches all."""
    if not rules:
        return items.limit(0)
    one = lambda r: (matches_glob(F.col("key_"), r.key_pattern or "*") & matches_glob(F.col("host_name"), r.host_pattern or "*"))
    return items.where(reduce(lambda a, b: a | b, map(one, rules)))


def score_band(score, pre_label: bool = False):
    """high, mid or low; or the label proposed for each: 1, -1, 0."""
    names = (1, -1, 0) if pre_label else ("high", "mid", "low")
    return F.when(score >= 0.5, names[0]).when(score > 0.1, names[1]).otherwise(names[2])
