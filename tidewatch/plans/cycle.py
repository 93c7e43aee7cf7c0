"""The engine's three axes as plans: hourly detection, daily statistics, and the fast watchlist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Source
from ..operators import cluster, detectors, fast, filters, gates, onset, panes, stats
from ..scratch import kept, materialize, scope
from ..sources.stores import Paned, Stores, event_path, write_event_file


@dataclass
class Inputs:
    """What a detection cycle looks at."""

    history: DataFrame
    trends: DataFrame
    items: DataFrame
    history_stats: DataFrame
    trends_stats: DataFrame
    hour_stats: DataFrame


@dataclass
class Findings:
    gated: DataFrame
    confirmed: DataFrame
    rescued: DataFrame
    clusters: DataFrame


def hour_of(endep: int) -> int:
    return endep % 86400 // 3600


def all_trend_stats(trends: DataFrame, cfg: Source, endep: int) -> tuple[DataFrame, DataFrame]:
    """Trend statistics and hour-of-day statistics of the retention window."""
    start = endep - cfg.trends_retention * 86400
    peak = cfg.metric_categories.recurring_peak
    full = stats.trend_stats(trends, start, endep, cfg.trends_range_to_sigma, cfg.history_window, peak.k_sigma, peak.exclude_recent_secs)
    return full, stats.hour_stats(stats.in_range(trends, start, endep))


def score_items(x: Inputs, cfg: Source, endep: int) -> DataFrame:
    """Ensemble scores: the cheap detectors first, change points only of what they found."""
    d = cfg.detectors
    found: dict[str, DataFrame] = {}
    if d.zscore.enabled:
        found["zscore"] = detectors.zscore_scores(x.history_stats, x.trends_stats, d.zscore)
    if d.seasonal.enabled:
        found["seasonal"] = detectors.seasonal_scores(x.history_stats, x.hour_stats, hour_of(endep), d.seasonal)
    if d.changepoint.enabled:
        history = x.history
        if found:
            ids = None
            for s in found.values():
                ids = s.select("itemid") if ids is None else ids.unionByName(s.select("itemid"))
            history = history.join(ids.distinct(), "itemid", "left_semi")
        found["changepoint"] = detectors.changepoint_scores(history, x.trends_stats, d.changepoint, cfg.history_interval)
    weights = {name: getattr(d, name).weight for name in found}
    return detectors.ensemble_scores(found, weights, cfg.ensemble)


def detect(x: Inputs, cfg: Source, endep: int, of: cluster.Cycle | None = None) -> Findings:
    """One cycle, from statistics to incidents; nothing is recorded. With `of`, several cycles whose items and clocks were
    brought to one, `of` an item its cycle.

    What several steps start from is cut to a table once, so no plan holds another one twice; the tables go with the
    cycle, but for the gated scores and the clusters, which go with the caller's scope.
    """
    with scope():
        fresh, _ = stats.split_stale(x.history_stats, endep, cfg.staleness_secs)
        items = materialize(x.items, "cycle-items")
        recent = materialize(filters.apply_item_filters(fresh, items, fresh.select("itemid", "mean"), cfg.item_filters), "cycle-recent")
        x = Inputs(x.history, x.trends, items, recent, materialize(x.trends_stats, "cycle-trend-stats"), materialize(x.hour_stats, "cycle-hours"))
        scores = materialize(score_items(x, cfg, endep).drop("is_anomaly"), "cycle-scores")
        ids = scores.select("itemid")
        # of the scored items only: few
        trends = materialize(x.trends.join(ids, "itemid", "left_semi"), "cycle-trends")
        history = materialize(x.history.join(ids, "itemid", "left_semi"), "cycle-history")
        c = cfg.clustering
        began = onset.anomaly_onset(trends, x.trends_stats, x.hour_stats, endep, cfg.history_window, cfg.detectors.zscore.lambda_threshold, cfg.detectors.seasonal.lambda_threshold, c.onset_tolerance)
        window = stats.in_range(history, endep - cfg.history_window, endep)
        gated = gates.apply_gates(scores, items, recent, x.trends_stats, cfg.metric_categories, cfg.ensemble.min_score, window, cfg.history_interval, materialize(began, "cycle-onsets"), endep, cfg.recency_max_age)
        gated = kept(filters.apply_anomaly_filters(gated, items, recent, x.trends_stats, cfg.anomaly_filters), "cycle-gated")
        confirmed = gated.where("is_anomaly")
        candidates = gates.rescue_candidates(gated, cfg.ensemble.min_score)
        if not c.rescue_same_incident:
            candidates = candidates.limit(0)
        flagged = confirmed.select("itemid").unionByName(candidates.select("itemid")).distinct()
        level = onset.level_onset(trends, x.trends_stats, c.onset_level_tol, c.sigma, c.onset_tolerance, c.onset_recent_samples)
        clusters = cluster.cluster_anomalies(stats.in_range(history, endep - c.detection_period, endep), flagged, c, items, level, of)
        clusters = kept(clusters, "cycle-clusters")
    return Findings(gated, confirmed, gates.select_rescued(candidates, clusters, confirmed), clusters)


def anomaly_rows(found: Findings, x_items: DataFrame, trend: DataFrame, endep: int) -> DataFrame:
    """Rows of the anomalies table for the confirmed and the rescued items."""
    both = found.confirmed.withColumn("rescued", F.lit(False)).unionByName(found.rescued.withColumn("rescued", F.lit(True)))
    j = both.join(x_items.select("itemid", "group_name", "hostid", "host_name", F.col("key_").alias("item_name")), "itemid")
    j = j.join(trend.select("itemid", F.col("mean").alias("trend_mean"), F.col("std").alias("trend_std")), "itemid", "left")
    return j.select("itemid", F.lit(endep).cast("long").alias("created"), "group_name", "hostid", F.lit(-1).alias("clusterid"), "host_name", "item_name", "trend_mean", "trend_std", "score", "detector_scores", "rescued")


def update_statistics(spark: SparkSession, source, stores: Stores, cfg: Source, endep: int) -> None:
    """The daily batch: one pass over the trends of the retention window; items without rows in it lose theirs."""
    start = endep - cfg.trends_retention * 86400
    ids = source.get_item_ids(cfg.item_names, cfg.host_names, cfg.group_names, cfg.item_ids, cfg.max_items)
    full, hours = all_trend_stats(source.get_trends(start, endep, ids), cfg, endep)
    stores.trends_stats.upsert(full)
    stores.trends_stats.delete_ids(ids.join(stores.trends_stats.read().where(F.col("last_clock") >= start), "itemid", "left_anti"))
    stores.hour_stats.replace(hours)
    stores.set_watermark(stores.trends_updates, start, endep)


def advance_statistics(spark: SparkSession, source, stores: Stores, cfg: Source, endep: int, late_secs: int = 7200) -> None:
    """update_statistics() from what arrived since the last time, and up to `late_secs` before it: only the hours that it touches
    are summed up anew, windows are put together from hours. The shape of peaks is still looked for in the stored rows."""
    start = endep - cfg.trends_retention * 86400
    _, done = stores.get_watermark(stores.trends_updates)
    peak = cfg.metric_categories.recurring_peak
    with scope():
        ids = materialize(source.get_item_ids(cfg.item_names, cfg.host_names, cfg.group_names, cfg.item_ids, cfg.max_items), "statistics-ids")
        paned = Paned(stores.trends, stores.trend_panes)
        paned.add(source.get_trends(max(start, done - late_secs) if done else start, endep, ids))
        parts = materialize(paned.within(start, endep).join(ids, "itemid", "left_semi"), "statistics-panes")
        base = materialize(panes.window_stats(parts, cfg.trends_range_to_sigma), "statistics-base")
        rows = stats.in_range(stores.trends.read(), start, endep).join(ids, "itemid", "left_semi")
        shape = stats.peak_stats(rows, base, cfg.history_window, peak.k_sigma, endep - peak.exclude_recent_secs)
        stores.trends_stats.upsert(base.join(shape, "itemid", "left"))
        stores.trends_stats.delete_ids(ids.join(stores.trends_stats.read().where(F.col("last_clock") >= start), "itemid", "left_anti"))
        stores.hour_stats.replace(panes.hour_stats(parts))
        paned.delete_before(start)
    stores.set_watermark(stores.trends_updates, start, endep)


def run_detection(spark: SparkSession, source, stores: Stores, cfg: Source, endep: int) -> DataFrame:
    """The hourly cycle: detects, records each anomaly once, drops old ones. Returns the new rows' itemids."""
    with scope():
        ids = materialize(source.get_item_ids(cfg.item_names, cfg.host_names, cfg.group_names, cfg.item_ids, cfg.max_items), "cycle-ids")
        start = endep - cfg.history_window
        history = materialize(source.get_history(min(start, endep - cfg.clustering.detection_period), endep, ids), "cycle-samples")
        stores.history_stats.replace(stats.window_stats(history, start, endep))
        stores.set_watermark(stores.history_updates, start, endep)
        trends = source.get_trends(endep - cfg.trends_retention * 86400, endep, ids)
        x = Inputs(history, trends, source.get_item_details(ids), stores.history_stats.read(), stores.trends_stats.read(), stores.read_hours())
        found = detect(x, cfg, endep)
        seen = stores.recorded_ids(endep - cfg.anomaly_keep_secs)
        rows = materialize(anomaly_rows(found, x.items, x.trends_stats, endep).join(seen, "itemid", "left_anti"), "cycle-new")
        new = kept(rows.select("itemid").distinct(), "cycle-new-ids")
        stores.record_cycle(rows, found.clusters, endep, endep - cfg.anomaly_keep_secs)
    return new


def fast_events(history: DataFrame, items: DataFrame, hours: DataFrame | None, events: DataFrame | None, cfg: Source, endep: int) -> tuple[DataFrame, DataFrame]:
    """Events of the watched items, and the scores that the hour's baseline suppressed."""
    f = cfg.fast_detect
    watched = filters.watchlist(items, f.watch)
    span = stats.in_range(history, endep - f.history_span_secs, endep).join(watched.select("itemid"), "itemid", "left_semi")
    recent, base = stats.short_window_stats(span, f.detect_window)
    scores = fast.fast_severity(recent, base, f)
    if f.seasonal_veto and hours is not None:
        judged = fast.seasonal_veto(scores, hours, hour_of(endep), f.seasonal_lambda)
    else:
        judged = scores.withColumn("seasonal_z", F.lit(None).cast("double")).withColumn("suppressed", F.lit(False))
    judged = materialize(judged, "fast-judged")
    kept = judged.where("not suppressed").drop("seasonal_z", "suppressed")
    clusters = cluster.cluster_anomalies(span, kept.select("itemid"), cfg.clustering) if f.cooccur else kept.select("itemid", F.lit(-1).alias("clusterid"))
    weights = None
    if f.use_events and events is not None:
        hosts = watched.select("host_name").distinct()
        window = stats.in_range(events, endep - (f.events_window_secs or f.history_span_secs), endep).join(hosts, "host_name", "left_semi")
        weights = fast.host_event_weights(window, f.events_saturation)
    scored = fast.score_events(kept, clusters, watched, weights).withColumn("host", F.lit(None).cast("string"))
    if weights is not None:
        covered = kept.join(watched, "itemid").select("host_name")
        scored = scored.unionByName(fast.event_only_events(weights, covered, f.min_event_score), allowMissingColumns=True)
    return materialize(scored, "fast-events"), judged.where("suppressed")


def run_fast(spark: SparkSession, source, stores: Stores, cfg: Source, endep: int, ds_name: str, n_sources: int = 1) -> dict:
    """The fast axis of one source: writes the event file and returns its document."""
    f = cfg.fast_detect
    with scope():
        items = materialize(source.get_item_details(source.get_item_ids(cfg.item_names, cfg.host_names, cfg.group_names, cfg.item_ids, cfg.max_items)), "fast-items")
        span = max(f.history_span_secs, f.events_window_secs)
        events = source.get_events(endep - span, endep) if f.use_events else None
        scored, quiet = fast_events(source.get_history(endep - f.history_span_secs, endep), items, stores.read_hours(hour_of(endep)), events, cfg, endep)
        return write_event_file(fast.build_result(scored, quiet, endep, f), event_path(f.output_path, ds_name, n_sources))
