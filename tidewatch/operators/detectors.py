"""Detectors: each gives scores in [0.5, 1] for the items that it finds abnormal, and no row for the others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Changepoint, Ensemble, Seasonal, ZScore
from ..functions.scalar import baseline_sigma, finite, score_ramp
from ..functions.sequence import cusum_peak
from .stats import sample_interval


def zscore_scores(recent: DataFrame, trend: DataFrame, cfg: ZScore) -> DataFrame:
    """(itemid, score, z, h_mean, t_mean): the recent mean against the long-term distribution."""
    t = trend.where("cnt > 0").select("itemid", F.col("mean").alias("t_mean"), F.col("std").alias("t_std"))
    j = recent.select("itemid", F.col("mean").alias("h_mean")).join(t, "itemid").where(finite(F.col("t_std")) > 0)
    delta = F.abs(F.col("h_mean") - F.col("t_mean"))
    big = (F.col("t_mean") == 0) | (F.try_divide(delta, F.abs("t_mean")) > cfg.min_ignore_rate)
    z = j.where(big).withColumn("z", delta / F.col("t_std")).where(finite(F.col("z")) >= cfg.lambda_threshold)
    return z.select("itemid", score_ramp(F.col("z"), cfg.lambda_threshold).alias("score"), "z", "h_mean", "t_mean")


def seasonal_scores(recent: DataFrame, hours: DataFrame, hour: int, cfg: Seasonal) -> DataFrame:
    """(itemid, score, z, h_mean, s_mean): the recent mean against the same hour of other days; no row, no score."""
    s = hours.where(F.col("hour_of_day") == hour).where(finite(F.col("std")) > 0).select("itemid", F.col("mean").alias("s_mean"), F.col("std").alias("s_std"))
    j = recent.select("itemid", F.col("mean").alias("h_mean")).join(s, "itemid")
    z = j.withColumn("z", F.abs(F.col("h_mean") - F.col("s_mean")) / F.col("s_std")).where(finite(F.col("z")) >= cfg.lambda_threshold)
    return z.select("itemid", score_ramp(F.col("z"), cfg.lambda_threshold).alias("score"), "z", "h_mean", "s_mean")


def changepoint_scores(history: DataFrame, trend: DataFrame, cfg: Changepoint, reference_interval: int) -> DataFrame:
    """(itemid, score, s_max): two-sided CUSUM integrated over time, so that the polling rate doesn't count."""
    sigma = finite(baseline_sigma(F.col("std"), F.col("intra_std")))
    base = trend.select("itemid", F.col("mean").alias("t_mean"), sigma.alias("sigma")).where("sigma > 0")
    w = sample_interval(history, reference_interval).select("itemid", (F.col("interval") / max(reference_interval, 1)).alias("w"))
    rows = history.where("value is not null").join(base, "itemid").join(w, "itemid")
    peak = cusum_peak(rows, (F.col("value") - F.col("t_mean")) * F.col("w"), cfg.cusum_k * F.col("sigma") * F.col("w"))
    j = peak.join(base, "itemid").withColumn("decision", cfg.cusum_h * F.col("sigma")).where(F.col("s_max") >= F.col("decision"))
    return j.select("itemid", score_ramp(F.col("s_max"), F.col("decision")).alias("score"), "s_max")


def ensemble_scores(scores: dict[str, DataFrame], weights: dict[str, float], cfg: Ensemble) -> DataFrame:
    """(itemid, score, is_anomaly, n_detectors, detector_scores): the weighted mean over the detectors that speak.

    A silent detector doesn't count; items with fewer than `require_any` speaking ones have no row. `weights` holds the
    enabled detectors; scores of others are ignored.
    """
    total = sum(weights.values()) or 1.0
    parts = [df.select("itemid", F.lit(name).alias("detector"), "score", F.lit(weights[name] / total).alias("w")) for name, df in scores.items() if name in weights]
    rows = reduce(DataFrame.unionByName, parts).where("score > 0")
    out = rows.groupBy("itemid").agg(
        (F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("score"), F.count("*").alias("n_detectors"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("detector", "score")))).alias("detector_scores"),
    )
    return out.where(F.col("n_detectors") >= cfg.require_any).select("itemid", "score", (F.col("score") >= cfg.min_score).alias("is_anomaly"), "n_detectors", "detector_scores")
