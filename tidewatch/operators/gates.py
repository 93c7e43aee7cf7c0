"""Gates shape a raw score: category weight times magnitude, duration, idle, peak and recency, each in [0, 1].

A gate that lacks what it needs is open (1); the detectors, in contrast, stay silent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Duration, IdleBaseline, MetricCategories, Recency, RecurringPeak
from ..functions.scalar import baseline_sigma, by_category, category_index, category_name, category_weight, finite, magnitude_of, ramp
from ..functions.sequence import longest_run
from .stats import sample_interval


def magnitude_gate(index: Column, cfg: MetricCategories, delta: Column, mean: Column, std: Column) -> Column:
    return by_category(index, cfg.categories, lambda c: magnitude_of(c.magnitude, delta, mean, std), 1.0)


def idle_gate(recent: Column, zero_cnt: Column, cnt: Column, max_value: Column, cfg: IdleBaseline) -> Column:
    """Closed for an item that idles at zero and stays within what it has reached before."""
    if not cfg.enabled:
        return F.lit(1.0)
    shut = (cnt > 0) & (F.try_divide(zero_cnt, cnt) >= cfg.max_zero_ratio) & (finite(recent) <= finite(max_value))
    return F.when(shut, float(cfg.floor)).otherwise(1.0)


def peak_gate(recent: Column, mean: Column, local_peak: Column, episodes: Column, cfg: RecurringPeak) -> Column:
    """Closed for a rise that the item has shown often enough and as high."""
    if not cfg.enabled:
        return F.lit(1.0)
    shut = (finite(recent) > finite(mean)) & (episodes >= cfg.min_episodes) & (finite(recent) <= finite(local_peak))
    return F.when(shut, float(cfg.floor)).otherwise(1.0)


def recency_gate(onset: Column, endep: int, max_age_secs: int, cfg: Recency) -> Column:
    """Closed for what started too long ago."""
    if not cfg.enabled or max_age_secs <= 0:
        return F.lit(1.0)
    return F.when(F.lit(endep) - onset > max_age_secs, float(cfg.floor)).otherwise(1.0)


def duration_gate(history: DataFrame, stats: DataFrame, cfg: Duration, reference_interval: int) -> DataFrame:
    """(itemid, duration): how long samples were outside the baseline; items it can't judge have no row."""
    sigma = finite(baseline_sigma(F.col("std"), F.col("intra_std")))
    base = stats.select("itemid", F.col("mean").alias("t_mean"), sigma.alias("sigma")).where("sigma > 0")
    rows = history.where("value is not null").join(base, "itemid")
    hit = F.abs(F.col("value") - F.col("t_mean")) > cfg.sigma * F.col("sigma")
    if cfg.measure == "consecutive":
        n = longest_run(rows, hit).select("itemid", F.col("longest").alias("n"))
    else:
        n = rows.groupBy("itemid").agg(F.count_if(hit).alias("n"))
    secs = n.join(sample_interval(history, reference_interval), "itemid")
    gate = F.greatest(ramp(F.col("n") * F.col("interval"), cfg.lo_secs, cfg.hi_secs), F.lit(float(cfg.floor)))
    return secs.select("itemid", gate.alias("duration"))


def apply_gates(scores: DataFrame, keys: DataFrame, recent: DataFrame, trend: DataFrame, cfg: MetricCategories, min_score: float, history: DataFrame | None = None, history_interval: int = 600, onsets: DataFrame | None = None, endep: int = 0, max_age_secs: int = 0) -> DataFrame:
    """`scores` (itemid, score, ..) with every multiplier, `raw_score`, the effective `score` and `is_anomaly`."""
    t = trend.select("itemid", F.col("mean").alias("t_mean"), F.col("std").alias("t_std"), "cnt", "zero_cnt", "max_value", "local_peak", "peak_episodes")
    j = scores.join(keys.select("itemid", "key_"), "itemid", "left").join(recent.select("itemid", F.col("mean").alias("r_mean")), "itemid", "left").join(t, "itemid", "left")
    if history is not None and cfg.duration.enabled:
        j = j.join(duration_gate(history, trend, cfg.duration, history_interval), "itemid", "left")
    else:
        j = j.withColumn("duration", F.lit(1.0))
    j = j.join(onsets.select("itemid", "onset"), "itemid", "left") if onsets is not None else j.withColumn("onset", F.lit(None).cast("long"))
    j = j.withColumn("index", category_index(F.coalesce("key_", F.lit("")), cfg.categories))
    both = F.col("r_mean").isNotNull() & F.col("t_mean").isNotNull()
    delta = F.when(both, F.abs(F.col("r_mean") - F.col("t_mean"))).otherwise(0.0)
    magnitude = F.when(both, magnitude_gate(F.col("index"), cfg, delta, F.col("t_mean"), F.col("t_std"))).otherwise(1.0)
    j = j.select(
        "*", category_name(F.col("index"), cfg).alias("category"), category_weight(F.col("index"), cfg).alias("weight"), magnitude.alias("magnitude"),
        idle_gate(F.col("r_mean"), F.col("zero_cnt"), F.col("cnt"), F.col("max_value"), cfg.idle_baseline).alias("idle"),
        peak_gate(F.col("r_mean"), F.col("t_mean"), F.col("local_peak"), F.col("peak_episodes"), cfg.recurring_peak).alias("peak"),
        recency_gate(F.col("onset"), endep, max_age_secs, cfg.recency).alias("recency"),
    ).withColumn("duration", F.coalesce("duration", F.lit(1.0)))
    gates = ("weight", "magnitude", "duration", "idle", "peak", "recency")
    effective = F.col("raw_score")
    for g in gates:
        effective = effective * F.col(g)
    j = j.withColumnRenamed("score", "raw_score").withColumn("score", effective).withColumn("is_anomaly", F.col("score") >= min_score)
    keep = [c for c in scores.columns if c not in ("itemid", "score", "is_anomaly", *gates)]
    return j.select("itemid", "score", "is_anomaly", "raw_score", "category", *gates, *keep)


def rescue_candidates(gated: DataFrame, min_score: float) -> DataFrame:
    """Items that only their magnitude kept from being anomalies."""
    rest = F.col("raw_score") * F.col("weight") * F.col("duration")
    return gated.where(~F.col("is_anomaly") & (F.col("raw_score") >= min_score) & (F.col("idle") == 1) & (F.col("peak") == 1) & (F.col("magnitude") < 1) & (rest >= min_score))


def select_rescued(candidates: DataFrame, clusters: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Candidates in a cluster that holds a confirmed item."""
    good = clusters.where("clusterid >= 0").join(confirmed.select("itemid"), "itemid", "left_semi").select("clusterid").distinct()
    return candidates.join(clusters.join(good, "clusterid", "left_semi").select("itemid"), "itemid", "left_semi")
