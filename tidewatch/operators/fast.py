"""The fast axis: a few watched items over a short window, scored together with the problem events of their hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FastDetect, ZScore
from ..functions.scalar import finite
from .detectors import zscore_scores


def fast_severity(recent: DataFrame, baseline: DataFrame, cfg: FastDetect) -> DataFrame:
    """Z-scores of the newest samples against the rest of the window, from `min_item_score` on."""
    return zscore_scores(recent, baseline, ZScore(lambda_threshold=cfg.lambda_threshold)).where(F.col("score") >= cfg.min_item_score)


def seasonal_veto(scores: DataFrame, hours: DataFrame, hour: int, seasonal_lambda: float) -> DataFrame:
    """All scores with `seasonal_z` and `suppressed`: true if this hour's own baseline expects the level."""
    h = hours.where(F.col("hour_of_day") == hour).where(finite(F.col("std")) > 0).groupBy("itemid").agg(F.min(F.struct("mean", "std")).alias("h"))
    z = F.abs(F.col("h_mean") - F.col("h.mean")) / F.col("h.std")
    j = scores.join(h, "itemid", "left").withColumn("seasonal_z", z).drop("h")
    return j.withColumn("suppressed", F.coalesce(F.col("seasonal_z") < seasonal_lambda, F.lit(False)))


def host_event_weights(events: DataFrame, saturation: float) -> DataFrame:
    """(host_name, weight) in [0, 1) from the severities of a host's events."""
    load = F.sum(F.least(F.greatest(F.coalesce("severity", F.lit(0)), F.lit(0)), F.lit(5)) / 5.0)
    return events.groupBy("host_name").agg((1 - F.exp(-load / max(saturation, 1e-9))).alias("weight"))


def score_events(scores: DataFrame, clusters: DataFrame, items: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """One event for each cluster, and for each item in none: noisy-or of its items' scores and its hosts' weights.

    Columns: score, n_items, cluster (-1 for a single item), reason, event_boost, items (item_id, host, key, score,
    recent_mean). `items` names each item's host_name and, if it is there, key_.
    """
    j = scores.join(clusters, "itemid", "left").withColumn("cluster", F.when(F.col("clusterid") >= 0, F.col("clusterid")).otherwise(-1))
    j = j.withColumn("group", F.when(F.col("cluster") >= 0, F.concat(F.lit("c"), "cluster")).otherwise(F.concat(F.lit("i"), "itemid")))
    named = [c for c in ("host_name", "key_") if items is not None and c in items.columns]
    j = j.join(items.select("itemid", *named), "itemid", "left") if named else j
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in named else F.lit("")
    level = F.col("h_mean") if "h_mean" in scores.columns else F.lit(None).cast("double")
    member = F.struct(F.col("itemid").alias("item_id"), text("host_name").alias("host"), text("key_").alias("key"), F.round("score", 4).alias("score"), level.alias("recent_mean"))
    found = j.groupBy("group", "cluster").agg(
        F.product(1 - F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))).alias("rest"), F.count("*").alias("n_items"), F.array_sort(F.collect_list(member)).alias("items"),
    )
    if weights is not None and "host_name" in named:
        each = j.select("group", "host_name").distinct().join(weights.where("weight > 0"), "host_name").groupBy("group").agg(F.product(1 - F.col("weight")).alias("host_rest"), F.max("weight").alias("boost"))
        found = found.join(each, "group", "left")
    else:
        found = found.withColumn("host_rest", F.lit(None).cast("double")).withColumn("boost", F.lit(None).cast("double"))
    score = 1 - F.col("rest") * F.coalesce("host_rest", F.lit(1.0))
    reason = F.when(F.col("n_items") >= 2, "novel co-occurrence").otherwise("single-item")
    return found.select(F.round(score, 4).alias("score"), "n_items", "cluster", reason.alias("reason"), F.round(F.coalesce("boost", F.lit(0.0)), 4).alias("event_boost"), "items")


#: The reason of events of a host alone.
HOST_EVENTS = "host_events"
_NO_ITEMS = "array<struct<item_id:long,host:string,key:string,score:double,recent_mean:double>>"


def event_only_events(weights: DataFrame, covered: DataFrame, min_event_score: float) -> DataFrame:
    """Events of hosts that no scored item covers."""
    rest = weights.where(F.col("weight") >= min_event_score).join(covered.select("host_name").distinct(), "host_name", "left_anti")
    score = F.round("weight", 4)
    return rest.select(score.alias("score"), F.lit(0).cast("long").alias("n_items"), F.lit(-1).alias("cluster"), F.lit(HOST_EVENTS).alias("reason"), score.alias("event_boost"), F.array().cast(_NO_ITEMS).alias("items"), F.col("host_name").alias("host"))


def event_order(events: DataFrame) -> list[Column]:
    """The order of the document's events, which numbers their pages too: highest score first."""
    by = {"reason": F.col("reason"), "cluster": F.col("cluster"), "items": F.to_json("items"), "host": F.col("host")}
    return [(-F.col("score")).alias("k0"), *(c.alias(f"k{i}") for i, (name, c) in enumerate(by.items(), 1) if name in events.columns)]


def build_result(events: DataFrame, suppressed: DataFrame, endep: int, cfg: FastDetect = FastDetect()) -> DataFrame:
    """One row: the event document (ts, max_score, n_events, events, suppressed, dashboard_url), highest score first. Events'
    boost and the reason of host events have the names in `cfg`."""
    reason = F.when(F.col("reason") == HOST_EVENTS, F.lit(cfg.host_events_reason)).otherwise(F.col("reason")).alias("reason")
    fields = [reason if c == "reason" else F.col(c).alias(cfg.boost_field if c == "event_boost" else c) for c in events.columns]
    order = F.struct(*event_order(events), F.struct(*fields).alias("e"))
    e = events.agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["e"]).alias("events"), F.max("score").alias("m"), F.count("*").alias("n_events"))
    s = suppressed.agg(F.array_sort(F.collect_list(F.struct(F.col("itemid").alias("item_id"), F.lit("seasonal_expected").alias("reason")))).alias("suppressed"))
    # one row each
    return e.crossJoin(s).select(F.lit(endep).cast("long").alias("ts"), F.round(F.coalesce("m", F.lit(0.0)), 4).alias("max_score"), "n_events", "events", "suppressed", F.lit(None).cast("string").alias("dashboard_url"))
