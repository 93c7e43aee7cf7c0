import json
import os

from collections import Counter
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch import config, schemas
from tidewatch.functions.scalar import category_index, category_name, matches_glob, ramp
from tidewatch.operators import cluster, detectors, evaluate, fast, filters, gates, pages, stats
from tidewatch.operators.graph import components
from tidewatch.plans import backtest, cycle
from tidewatch.plans.lock import Held, single_instance
from tidewatch.sources.files import CsvSource, read_labels
from tidewatch.sources import stores
from tidewatch.sources.jdbc import JdbcSource
from tidewatch.sources.stores import Stores, write_csv, write_event_file
from tidewatch.streaming import fast as stream


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_window_stats_edges(spark):
    h = spark.createDataFrame([(1, 0, 5.0), (1, 10, 7.0), (1, 11, 99.0), (2, 5, 3.0), (3, 5, None), (4, 5, float("nan")), (5, 1, 0.0), (5, 2, 0.0)], schemas.HISTORY)
    got = {r.itemid: r for r in stats.window_stats(h, 0, 10).collect()}
    assert set(got) == {1, 2, 5}
    assert (got[1].cnt, got[1].mean, got[1].last_clock) == (2, 6.0, 10) and abs(got[1].std - 2**0.5) < 1e-12
    assert got[2].std == 0 and got[5].zero_cnt == 2
    assert stats.window_stats(h.limit(0), 0, 10).count() == 0


def test_staleness_cut_counts(spark):
    s = spark.createDataFrame([(1, 100), (2, 99), (3, None)], "itemid long, last_clock long")
    fresh, stale = stats.split_stale(s, 200, 100)
    assert rows(fresh, "itemid") == [(1,)] and rows(stale, "itemid") == [(2,), (3,)]
    assert stats.split_stale(s, 200, 0)[0].count() == 3


def test_zscore_thresholds(spark):
    t = spark.createDataFrame([(i, 100.0, 10.0, 5) for i in range(5)] + [(9, 100.0, 0.0, 5)], "itemid long, mean double, std double, cnt long")
    r = spark.createDataFrame([(0, 130.0), (1, 129.9), (2, 200.0), (3, 145.0), (9, 500.0)], "itemid long, mean double")
    got = {x.itemid: x.score for x in detectors.zscore_scores(r, t, config.ZScore()).collect()}
    assert got == {0: 0.5, 2: 1.0, 3: 0.75}


def test_cusum_does_not_depend_on_the_polling_rate(spark):
    t = spark.createDataFrame([(1, 0.0, 1.0, None), (2, 0.0, 1.0, None)], "itemid long, mean double, std double, intra_std double")
    h = spark.createDataFrame([(1, 600 * k, 2.0) for k in range(12)] + [(2, 60 * k, 2.0) for k in range(120)], schemas.HISTORY)
    got = {r.itemid: r.s_max for r in detectors.changepoint_scores(h, t, config.Changepoint(), 600).collect()}
    assert abs(got[1] - got[2]) < 1e-9


def test_silent_detectors_do_not_dilute(spark):
    a = spark.createDataFrame([(1, 0.8), (2, 0.9)], "itemid long, score double")
    b = spark.createDataFrame([(1, 0.6)], "itemid long, score double")
    out = detectors.ensemble_scores({"a": a, "b": b, "off": a}, {"a": 0.3, "b": 0.3, "c": 0.4}, config.Ensemble(0.7, 1)).collect()
    assert {r.itemid: (round(r.score, 9), r.is_anomaly) for r in out} == {1: (0.7, True), 2: (0.9, True)}
    assert [r.itemid for r in detectors.ensemble_scores({"a": a, "b": b}, {"a": 0.5, "b": 0.5}, config.Ensemble(0.7, 2)).collect()] == [1]


def test_globs_and_categories(spark):
    df = spark.createDataFrame([("net.if.in[eth0]",), ("net.if.in.packets[eth0]",), ("xnet.if",), ("vm.memory.size[available]",), ("odd",)], "k string")
    assert rows(df.where(matches_glob(F.col("k"), "net.if.*")), "k") == [("net.if.in.packets[eth0]",), ("net.if.in[eth0]",)]
    got = dict(rows(df.select("k", category_name(category_index(F.col("k"), config.CATEGORIES), config.MetricCategories()).alias("c")), "k", "c"))
    assert got["net.if.in.packets[eth0]"] == "packets" and got["net.if.in[eth0]"] == "network" and got["odd"] == "default"


def test_ramp(spark):
    x = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 3.0)], "x double")
    assert [r[0] for r in x.select(ramp(F.col("x"), 1, 3)).collect()] == [0, 0, 0.5, 1]
    assert [r[0] for r in x.select(ramp(F.col("x"), 2, 2)).collect()] == [0, 0, 1, 1]


def test_linkage_on_a_chain():
    d = np.array([[0, 0.08, 0.6], [0.08, 0, 0.08], [0.6, 0.08, 0]])
    assert len(set(cluster.agglomerate(d, 0.1, "complete").tolist())) == 2
    assert len(set(cluster.density(d, 0.1, 2).tolist())) == 1


def slow_complete(d, eps):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        best = min((max(d[x, y] for x in a for y in b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best[0] >= eps:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_complete_linkage_against_a_naive_one():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(2, 9))
        d = rng.random((n, n))
        d = (d + d.T) / 2
        got = cluster.agglomerate(d, 0.5, "complete")
        assert {frozenset(np.flatnonzero(got == x).tolist()) for x in set(got.tolist())} == slow_complete(d, 0.5)


def test_clusters_follow_the_shape_and_the_onset(spark):
    rng = np.random.default_rng(2)
    shapes = rng.standard_normal((2, 20)).cumsum(axis=1) * 10
    h = spark.createDataFrame([(i, 600 * k, float(shapes[i % 2][k] + i)) for i in range(6) for k in range(20)], schemas.HISTORY)
    ids = spark.range(6).select(F.col("id").alias("itemid"))
    got = dict(rows(cluster.cluster_anomalies(h, ids, config.Clustering()), "itemid", "clusterid"))
    assert len({got[0], got[2], got[4]}) == 1 and got[0] >= 0 and got[0] != got[1] and len({got[1], got[3], got[5]}) == 1
    onsets = spark.createDataFrame([(0, 0), (2, 0), (4, 90_000)], schemas.ONSETS)
    apart = dict(rows(cluster.cluster_anomalies(h, ids, config.Clustering(), None, onsets), "itemid", "clusterid"))
    assert apart[0] == apart[2] != apart[4]
    short = h.where("clock < 3000")
    assert {r.clusterid for r in cluster.cluster_anomalies(short, ids, config.Clustering()).collect()} == {-1}


def test_filters_keep_what_they_do_not_know(spark):
    items = spark.createDataFrame([(1, "system.uptime", "s"), (2, "net.if.in[eth0]", "bps"), (3, "net.if.in[eth1]", "bps")], "itemid long, key_ string, units string")
    recent = spark.createDataFrame([(1, 5.0), (2, 9e6), (3, 1.0), (4, 1.0)], "itemid long, mean double")
    ids = spark.range(1, 6).select(F.col("id").alias("itemid"))
    assert rows(filters.apply_item_filters(ids, items, recent, config.ITEM_FILTERS), "itemid") == [(2,), (4,), (5,)]
    scores = spark.createDataFrame([(2, 1.0), (3, 1.0), (9, 1.0)], "itemid long, score double")
    trend = spark.createDataFrame([(2, 1.0), (3, 1.0)], "itemid long, mean double")
    assert rows(filters.apply_anomaly_filters(scores, items, recent, trend, config.ANOMALY_FILTERS), "itemid") == [(2,), (9,)]


def test_gates_fail_open(spark):
    one = spark.createDataFrame([(1, None, None, None)], "itemid long, a double, b double, onset long")
    cols = [gates.idle_gate(F.col("a"), F.col("b"), F.col("b"), F.col("b"), config.IdleBaseline()), gates.peak_gate(F.col("a"), F.col("b"), F.col("b"), F.col("onset"), config.RecurringPeak()), gates.recency_gate(F.col("onset"), 100, 10, config.Recency())]
    assert list(one.select(*cols).first()) == [1.0, 1.0, 1.0]


def test_noisy_or_counts_hosts_once(spark):
    s = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 1.0)], "itemid long, score double")
    c = spark.createDataFrame([(1, 0), (2, 0)], schemas.CLUSTERS)
    hosts = spark.createDataFrame([(1, "h"), (2, "h"), (3, "g")], "itemid long, host_name string")
    w = spark.createDataFrame([("h", 0.5)], "host_name string, weight double")
    got = rows(fast.score_events(s, c, hosts, w), "score", "n_items", "reason")
    assert got == [(0.875, 2, "novel co-occurrence"), (1.0, 1, "single-item")]
    assert rows(fast.event_only_events(w, hosts.where("host_name = 'g'"), 0.5), "host") == [("h",)]


def test_cluster_metrics(spark):
    labels = spark.createDataFrame([(i, 1, "", "ab"[i // 2], 1.0) for i in range(4)] + [(9, 0, "", "", 1.0)], schemas.LABELS)
    perfect = spark.createDataFrame([(i, i // 2) for i in range(4)], schemas.CLUSTERS)
    m = evaluate.cluster_metrics(perfect, labels).first()
    assert (m.pair_tp, m.pair_fp, m.pair_fn) == (2, 0, 0) and all(abs(x - 1) < 1e-9 for x in (m.ari, m.homogeneity, m.completeness, m.v_measure))
    noise = spark.createDataFrame([(i, -1) for i in range(4)], schemas.CLUSTERS)
    m = evaluate.cluster_metrics(noise, labels).first()
    assert (m.pair_tp, m.pair_fp, m.pair_fn) == (0, 0, 2) and abs(m.homogeneity - 1) < 1e-9


def test_synthetic_recall(spark):
    recent, trend, labels = backtest.synthetic_dataset(spark)
    m = evaluate.detection_metrics(detectors.zscore_scores(recent, trend, config.ZScore()), labels).first()
    assert m.recall == 1.0 and m.precision == 1.0


def test_stores(spark, tmp_path):
    st = Stores(spark, f"file://{tmp_path}", "ds")
    st.init()
    assert all(t.read().count() == 0 for t in st.all())
    st.history.upsert(spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0)], schemas.HISTORY))
    st.history.upsert(spark.createDataFrame([(1, 1, 9.0), (1, 2, 3.0)], schemas.HISTORY))
    assert rows(st.read_history(startep=1, endep=1), "itemid", "value") == [(1, 9.0), (2, 2.0)]
    st.history.delete_ids(spark.createDataFrame([(2,)], "itemid long"))
    assert st.history.read().count() == 2
    st.set_watermark(st.trends_updates, 5, 6)
    assert st.get_watermark(st.trends_updates) == (5, 6) and st.get_watermark(st.history_updates) == (0, 0)
    a = spark.createDataFrame([(1, 100, "g", 1, -1, "h", "it's" + "x" * 300, float("nan"), 1.0, 0.9, {"z": 0.9}, False)], schemas.ANOMALIES)
    st.insert_anomalies(a)
    st.update_clusters(spark.createDataFrame([(1, 4)], schemas.CLUSTERS), 100)
    row = st.read_anomalies().first()
    assert (row.clusterid, row.trend_mean, len(row.item_name)) == (4, 0.0, 255) and "'" not in row.item_name
    st.insert_anomalies(a)
    assert st.read_anomalies().first().clusterid == 4
    st.anomalies.delete_before("created", 101)
    assert st.recorded_ids().count() == 0


def test_csv_source(spark, tmp_path):
    w = lambda name, df: write_csv(df, f"file://{tmp_path}/{name}.csv.gz")
    w("history", spark.createDataFrame([("1", "10", "1.5"), ("itemid", "clock", "value"), ("1", "bad", "2"), ("2", "20", "3")], "a string, b string, c string"))
    w("trends", spark.createDataFrame([("1", "0", "x", "2", "3")], "a string, b string, c string, d string, e string"))
    w("items", spark.createDataFrame([("g", "7", "h", "1", "net.if.in[eth0]")], "group_name string, hostid string, host_name string, itemid string, item_name string"))
    s = CsvSource(spark, config.Source(data_dir=f"file://{tmp_path}"))
    assert s.check_conn() and rows(s.get_history(0, 20), "itemid", "clock", "value") == [(1, 10, 1.5), (2, 20, 3.0)]
    assert rows(s.get_history(0, 10), "itemid") == [(1,)]
    assert s.get_trends(0, 10).first().value_min == 0.0
    assert s.get_item_details().first().key_ == "net.if.in[eth0]" and s.get_item_details().first().units == ""
    assert s.get_events(0, 10).count() == 0
    assert rows(s.get_item_ids(max_items=1), "itemid") == [(1,)]
    (tmp_path / "labels.csv").write_text("item_id,label,note\n1,1,x\n2,-1,\n")
    assert rows(read_labels(spark, f"file://{tmp_path}/labels.csv"), "item_id", "label", "incident", "confidence") == [(1, 1, "", 1.0), (2, -1, "", 1.0)]


def test_events_meet_hosts_not_items(spark):
    """Two events of a trigger with 1,000 items on two hosts: a row for each event and host, and items go before the events are joined."""
    t = {
        "events": spark.createDataFrame([(k, 5, 2, "n", 7, 0, 0, 1) for k in (1, 2)], "eventid long, clock long, severity int, name string, objectid long, source int, object int, value int"),
        "triggers": spark.createDataFrame([(7,)], "triggerid long"),
        "functions": spark.range(1000).selectExpr("7L as triggerid", "id as itemid"),
        "items": spark.range(1000).selectExpr("id as itemid", "id % 2 as hostid"),
        "hosts": spark.createDataFrame([(0, "a"), (1, "b")], "hostid long, name string"),
    }
    found = JdbcSource(spark, config.Source(type="jdbc", options={"reader": t.get})).get_events(0, 10)
    assert rows(found, "clock", "host_name") == [(5, "a"), (5, "a"), (5, "b"), (5, "b")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2


def test_event_file(spark, tmp_path):
    e = spark.createDataFrame([(0.5, 1)], "score double, n_items long")
    q = spark.createDataFrame([(9, 1.0)], "itemid long, seasonal_z double")
    out = f"{tmp_path}/events.json"
    write_event_file(fast.build_result(e, q, 77), f"file://{out}")
    write_event_file(fast.build_result(e, q, 78), f"file://{out}")
    got = json.load(open(out))
    assert (got["ts"], got["n_events"], got["max_score"]) == (78, 1, 0.5) and not os.path.exists(f"{out}.tmp")
    assert got["suppressed"] == [{"item_id": 9, "reason": "seasonal_expected"}] and got["dashboard_url"] is None


def test_event_document(spark, tmp_path):
    s = spark.createDataFrame([(1, 0.5, 100.0), (2, 0.5, 3.0), (3, 0.25, None)], "itemid long, score double, h_mean double")
    c = spark.createDataFrame([(1, 0), (2, 0)], schemas.CLUSTERS)
    items = spark.createDataFrame([(1, "h", "k1"), (2, "h", "k2")], "itemid long, host_name string, key_ string")
    w = spark.createDataFrame([("g", 0.8)], "host_name string, weight double")
    events = fast.score_events(s, c, items).withColumn("host", F.lit(None).cast("string")).unionByName(fast.event_only_events(w, items, 0.5))
    none = spark.createDataFrame([], "itemid long, seasonal_z double")
    got = write_event_file(fast.build_result(events, none, 1782259742), f"file://{tmp_path}/e.json")
    assert {k: got[k] for k in ("ts", "max_score", "n_events", "suppressed", "dashboard_url")} == {"ts": 1782259742, "max_score": 0.8, "n_events": 3, "suppressed": [], "dashboard_url": None}
    alone, pair, single = got["events"]
    assert alone == {"score": 0.8, "n_items": 0, "cluster": -1, "reason": "host_events", "event_boost": 0.8, "items": [], "host": "g"}
    assert pair["score"] == 0.75 and pair["cluster"] == 0 and pair["items"][0] == {"item_id": 1, "host": "h", "key": "k1", "score": 0.5, "recent_mean": 100.0} and "host" not in pair
    assert single["cluster"] == -1 and single["items"] == [{"item_id": 3, "host": "", "key": "", "score": 0.25, "recent_mean": None}]
    paged = rows(pages.pages_for_events(events), "page", "itemid", "pos")
    assert paged == [("event2_cluster0", 1, 0), ("event2_cluster0", 2, 1), ("event3", 3, 0)]
    named = fast.build_result(events, none, 1, config.FastDetect(boost_field="boost", host_events_reason="problems")).first().events
    assert named[0].reason == "problems" and named[0].boost == 0.8 and "event_boost" not in named[0]
    empty = write_event_file(fast.build_result(events.limit(0), none, 123), f"file://{tmp_path}/e.json")
    assert empty == {"ts": 123, "max_score": 0.0, "n_events": 0, "events": [], "suppressed": [], "dashboard_url": None}


def test_pages_are_numbered_as_the_document(spark):
    """Events of equal score: a page shows the event that the document lists at its number."""
    rng = np.random.default_rng(4)
    s = spark.createDataFrame([(i, 0.5, float(rng.integers(3))) for i in range(12)], "itemid long, score double, h_mean double")
    c = spark.createDataFrame([(i, int(rng.integers(-1, 4))) for i in range(12)], schemas.CLUSTERS)
    items = spark.createDataFrame([(i, f"h{i % 3}", f"k{9 - i}") for i in range(12)], "itemid long, host_name string, key_ string")
    w = spark.createDataFrame([("g", 0.5), ("f", 0.5)], "host_name string, weight double")
    events = fast.score_events(s, c, items).withColumn("host", F.lit(None).cast("string")).unionByName(fast.event_only_events(w, items, 0.5))
    listed = fast.build_result(events, spark.createDataFrame([], "itemid long, seasonal_z double"), 1).first().events
    want = {(f"event{k}" + (f"_cluster{e.cluster}" if e.cluster >= 0 else ""), x.item_id, pos) for k, e in enumerate(listed, 1) for pos, x in enumerate(e["items"])}
    assert set(rows(pages.pages_for_events(events.repartition(3)), "page", "itemid", "pos")) == want and len(want) == 12


def test_dashboard_items(spark):
    field = lambda n, v: {"name": n, "value": v}
    simple = {"type": "graph", "fields": [field("source_type", "1"), field("itemid", "7"), field("graphid", "1")]}
    drawn = {"type": "graph", "fields": [field("graphid", "1"), field("itemid", "99")]}
    svg = {"type": "svggraph", "fields": [field("ds.0.itemids.0", "8"), field("ds.0.itemids.1", "x")]}
    boards = [{"pages": [{"widgets": [simple, drawn]}, {"widgets": [svg, {"type": "clock", "fields": [field("itemid", "55")]}]}]}, {"widgets": [{**drawn, "fields": [field("graphid", "2")]}]}, {}]
    df = spark.createDataFrame([(json.dumps(x),) for x in boards], "json string")
    assert rows(pages.dashboard_widgets(df), "kind", "id") == [("graph", 1), ("graph", 2), ("item", 7), ("item", 8)]
    graphs = spark.createDataFrame([(1, 20), (1, 21), (2, 20), (3, 30)], "graphid long, itemid long")
    assert rows(pages.dashboard_items(df, graphs), "itemid") == [(20,), (21,), (7,), (8,)]


def test_cluster_pages(spark):
    an = lambda data: spark.createDataFrame(data, "group_name string, hostid long, clusterid int, itemid long")
    got = rows(pages.pages_by_cluster(an([("A", 1, 5, 10), ("A", 1, 5, 10), ("B", 2, 5, 11), ("C", 3, 7, 20), ("D", 4, -1, 30)])), "page", "itemid", "pos")
    assert got == [("cluster5", 10, 0), ("cluster5", 11, 1), ("singletons", 20, 1), ("singletons", 30, 0)]
    many = [("g", h, c + 100, c * 10 + h) for c in range(60) for h in (0, 1)]
    assert pages.pages_by_cluster(an(many)).select("page").distinct().count() == 50
    noisy = pages.pages_by_cluster(an([*many, ("g", 1, -1, 9999)]))
    assert noisy.select("page").distinct().count() == 50 and rows(noisy.where("page = 'singletons'"), "itemid") == [(9999,)]
    cycles = an([("g", 1, 0, 11), ("g", 2, 0, 12), ("g", 1, 0, 21), ("g", 2, 0, 22)]).withColumn("created", F.when(F.col("itemid") < 20, 1000).otherwise(9000))
    assert rows(pages.pages_by_cluster(cycles), "page", "itemid") == [("cluster0", 11), ("cluster0", 12), ("cluster1000", 21), ("cluster1000", 22)]


def test_grid_of_widgets(spark):
    paged = spark.createDataFrame([("A", i) for i in range(101, 106)], "page string, itemid long")
    labels = spark.createDataFrame([(101, "h: k")], "itemid long, header string")
    got = rows(pages.page_layout(paged, labels), "itemid", "x", "y", "header")
    assert got == [(101, 0, 0, "h: k"), (102, 15, 0, ""), (103, 30, 0, ""), (104, 45, 0, ""), (105, 0, 5, "")]
    bands = spark.createDataFrame([(1, 0.9, "high"), (2, 0.0, "low"), (3, 0.95, "high")], "itemid long, score double, band string")
    got = rows(pages.page_layout(pages.pages_by_band(bands), width=pages.REVIEW_WIDTH, suffix_always=False), "page", "itemid", "x")
    assert got == [("high_score", 1, 16), ("high_score", 3, 0), ("low_score", 2, 0)]


def test_saved_notes(spark):
    labels = spark.createDataFrame([(1, 1, "i", 0.5), (2, 0, "", 1.0), (3, -1, "", 1.0)], "item_id long, label int, incident string, confidence double")
    assert rows(pages.labels_for_saving(labels), "item_id", "note", "confidence") == [(1, "anomaly", 0.5), (2, "normal", None), (3, "skip", None)]


def test_queue_and_master(spark):
    items = spark.createDataFrame([(i, f"h{i}", "k") for i in range(40)], "itemid long, host_name string, key_ string")
    scores = spark.createDataFrame([(i, 0.3 if i < 20 else 0.0) for i in range(40)], "itemid long, score double")
    z = spark.createDataFrame([(1, 1.0, 9.0), (2, 0.9, 5.25)], "itemid long, score double, z double")
    done = spark.createDataFrame([("h2", "k"), ("h3", "k")], "host_name string, key_ string")
    got = pages.review_queue(scores, items, done, 5, 4, 3, 7, zscores=z).collect()
    assert [(r.itemid, r.reason) for r in got if r.band == "flagged"] == [(1, "first-stage z=9.0")]
    assert sorted(r.band for r in got) == ["boundary"] * 4 + ["control"] * 3 + ["flagged"] and not {2, 3} & {r.itemid for r in got}
    an = spark.createDataFrame([(i, 50, "g", i, 0 if i < 3 else -1, 0.9 - i / 100, i == 2) for i in (0, 1, 2, 5)], "itemid long, created long, group_name string, hostid long, clusterid int, score double, rescued boolean")
    got = pages.review_queue(scores, items, done, 5, 4, 3, 7, anomalies=an).where("band = 'flagged'").collect()
    assert sorted((r.itemid, r.clusterid, r.reason) for r in got) == [(0, 0, "incident cluster 0 (3 items, 1 rescued)"), (5, -1, "flagged (unclustered)")]
    assert rows(pages.replay_candidates(an, scores.where("itemid > 18"), 60), "itemid") == [(19,)]
    assert rows(pages.replay_candidates(an, scores.where("itemid > 18"), 50), "itemid") == [(0,), (1,), (19,), (2,), (5,)]


def test_config(tmp_path, monkeypatch):
    p = tmp_path / "c.yml"
    monkeypatch.setenv("WHERE", "/data")
    p.write_text("detectors: {zscore: {weight: 0.5}}\ndata_sources:\n  a: {type: csv, data_dir: \"{{ WHERE }}/x\", detectors: {zscore: {lambda_threshold: 4}}}\n  b: {type: csv, data_dir: \"{{ NONE | default('y') }}\"}\n")
    c = config.load_config(str(p))
    a = c.data_sources["a"]
    assert (a.data_dir, a.detectors.zscore.weight, a.detectors.zscore.lambda_threshold, a.ensemble.min_score) == ("/data/x", 0.5, 4.0, 0.7)
    assert c.data_sources["b"].data_dir == "y" and c.data_sources["b"].detectors.zscore.lambda_threshold == 3.0
    p.write_text("data_sources: {a: {clustering: {linkage: single}}}")
    with pytest.raises(ValueError):
        config.load_config(str(p))


def test_lock(tmp_path):
    with single_instance("x", str(tmp_path)):
        with pytest.raises(Held):
            with single_instance("x", str(tmp_path)):
                pass
        with single_instance("y", str(tmp_path)):
            pass
    with single_instance("x", str(tmp_path)):
        assert (tmp_path / "x.lock").read_text().startswith(str(os.getpid()))


def test_pages(spark):
    an = spark.createDataFrame([(i, 100, "g", i % 2, 0 if i < 4 else -1) for i in range(6)], "itemid long, created long, group_name string, hostid long, clusterid int")
    assert rows(pages.pages_by_group(an), "itemid") == [(0,), (1,), (4,), (5,)]
    many = spark.range(100).select(F.lit("p").alias("page"), F.col("id").alias("itemid"))
    got = pages.page_layout(many)
    assert {r.page: r["count"] for r in got.groupBy("page").count().collect()} == {"p_1": 48, "p_2": 48, "p_3": 4}


def test_replay_records_once(spark):
    end = 1_700_000_000 - 1_700_000_000 % 3600
    rng = np.random.default_rng(3)
    hist, trends = [], []
    for i in range(4):
        for h in range(14 * 24):
            t = end - 3600 * (14 * 24 - h)
            v = 100 + float(rng.normal(0, 3)) + (300 if i == 0 and t >= end - 7200 else 0)
            trends.append((i, t, v - 2, v, v + 2))
        for k in range(72):
            t = end - 600 * (71 - k)
            hist.append((i, t, 100 + float(rng.normal(0, 3)) + (300 if i == 0 and t >= end - 7200 else 0)))
    items = spark.createDataFrame([("g", 1, "h", i, f"k{i}", "", f"k{i}") for i in range(4)], schemas.ITEMS)
    cfg = config.Source()
    out = backtest.replay_cycles(spark.createDataFrame(hist, schemas.HISTORY), spark.createDataFrame(trends, schemas.TRENDS), items, cfg, [end - 600, end])
    assert sorted(rows(out, "endep", "itemid", "detected", "recorded", "retained")) == [(end - 600, 0, True, True, True), (end, 0, True, False, True)]
    labels = spark.createDataFrame([(i, int(i == 0), "", "", 1.0) for i in range(4)], schemas.LABELS)
    m = backtest.backtest(spark.createDataFrame(hist, schemas.HISTORY), spark.createDataFrame(trends, schemas.TRENDS), items, labels, cfg, end)
    assert rows(m["detection"].where("threshold = 0.5"), "tp", "fp", "fn") == [(1, 0, 0)]
    assert m["scores"].where("is_anomaly").count() == 1


def test_replay_is_the_cycles_in_order(spark):
    """Cycles as one plan: what a loop over detection cycles finds, item by item."""
    end = 1_700_000_000 - 1_700_000_000 % 3600 + 1234
    rng = np.random.default_rng(9)
    hist, trends = [], []
    shape = rng.normal(0, 40, 400)
    for i in range(9):
        calm = lambda t: 100 + 3 * i + float(rng.normal(0, 3)) + (150 + float(shape[(end - t) // 600 % 400]) if i < 5 and end - 9000 * (i + 2) <= t < end - 2000 * i else 0)  # noqa: B023, E731
        trends += [(i, t, v - 2, v, v + 2) for h in range(8 * 24) for t in (end - 3600 * h - 600,) for v in (calm(t),)]
        hist += [(i, t, calm(t)) for k in range(400) for t in (end - 600 * k,) if rng.random() < 0.97]
    items = spark.createDataFrame([("g", 1, "h", i, f"k{i % 2}[{i}]", "", f"k{i % 2}[{i}]") for i in range(9)], schemas.ITEMS)
    h, tr = spark.createDataFrame(hist, schemas.HISTORY).cache(), spark.createDataFrame(trends, schemas.TRENDS).cache()
    cfg = config.Source(trends_retention=6, anomaly_keep_secs=20_000, clustering=config.Clustering(detection_period=20_000, corr_eps=0.45))
    cycles = [end - 9000 * k for k in range(6)]
    got = backtest.replay_cycles(h, tr, items, cfg, cycles).collect()
    alone, recorded, want = replace(cfg, staleness_secs=0), {}, set()
    for e in sorted(cycles):
        until = F.col("clock") <= e
        found = cycle.detect(backtest.inputs_at(h.where(until), tr.where(until), items, alone, e), alone, e)
        ids = {r.itemid for r in found.confirmed.select("itemid").union(found.rescued.select("itemid")).collect()}
        recorded = {i: t for i, t in recorded.items() if e - t <= cfg.anomaly_keep_secs}
        new = ids - recorded.keys()
        recorded |= dict.fromkeys(new, e)
        want |= {(e, i, i in ids, i in new, i in recorded) for i in ids | recorded.keys()}
    assert {(r.endep, r.itemid, r.detected, r.recorded, r.retained) for r in got} == want and len(got) == len(want)
    assert len({r.itemid for r in got if r.recorded}) >= 3 and max(Counter(r.itemid for r in got if r.recorded).values()) > 1


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(50, 90)] + [(int(a), int(b)) for a, b in rng.integers(100, 160, (50, 2))] + [(1, 1)] + [(200, k) for k in range(201, 300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.s: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def series(n, groups, noise, seed=5, length=48):
    """n walks of which items with one number modulo `groups` move together."""
    rng = np.random.default_rng(seed)
    shapes = rng.standard_normal((groups, length))
    return [(i, k, float(v)) for i in range(n) for k, v in enumerate((shapes[i % groups] + noise * rng.standard_normal(length)).cumsum())]


def test_close_pairs_against_all_pairs(spark):
    for n, groups, noise, eps in ((300, 6, 0.2, 0.3), (200, 200, 0.0, 0.4), (150, 4, 1.0, 0.25)):
        charts = spark.createDataFrame(series(n, groups, noise), "itemid long, bucket long, value double")
        keys = spark.createDataFrame([(i, f"k{i % 3}[x]") for i in range(n)], "itemid long, key_ string")
        want = cluster.pair_distances(charts, keys, 0.9).where(F.col("distance") < eps)
        got = cluster.close_pairs(charts, eps, keys, 0.9)
        pairs = lambda df: {(r.i, r.j): r.distance for r in df.collect()}
        want, got = pairs(want), pairs(got)
        assert want.keys() == got.keys() and len(got) and all(abs(want[k] - got[k]) < 1e-9 for k in got)


def test_all_pairs_meet_in_blocks(spark):
    """Pairs, onsets and families included, come from the blocks: no join has the pairs on a side. Spearman from ranks that are put
    in by hand; correlations of exactly the threshold count."""
    n = 9
    rng = np.random.default_rng(1)
    c = 2 * np.arange(45) - 44
    while len(at := np.argwhere(np.triu((x := np.stack([rng.permutation(c) for _ in range(600)])) @ x.T * 10 == 3 * (c @ c), 1))) < n:
        pass
    pairs = [tuple(map(int, p)) for p in at[:n]]
    # each pair in a family of its own
    charts = spark.createDataFrame([(2 * k + s, b, float(v)) for k, p in enumerate(pairs) for s in (0, 1) for b, v in enumerate(x[p[s]])], "itemid long, bucket long, value double")
    keys = spark.createDataFrame([(k, f"k{k // 2}[x]") for k in range(2 * n)], "itemid long, key_ string")
    onsets = spark.createDataFrame([(0, 0), (1, 10), (2, 100), (3, 0)], "itemid long, onset long")
    found = cluster.pair_distances(charts, keys, 0.3, onsets=onsets, max_gap=50)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan.splitlines()[0] and "Cross" not in plan
    got = {(r.i, r.j): r.distance for r in found.collect()}
    assert len(got) == n * (2 * n - 1)
    # 0 and 1 are near enough, 2 and 3 aren't
    assert got[0, 1] <= 0.35 and got[2, 3] == 1 and all(got[2 * k, 2 * k + 1] <= 0.35 for k in range(2, n))
    assert {k for k, d in got.items() if d == 1} == {(0, 2), (1, 2), (2, 3)}


def test_copies_are_linked_as_items(spark):
    """Copies of series, flat ones among them: the groups of the classes are those of all items, by every linkage."""
    base = [(i, k, v) for i, k, v in series(12, 4, 0.7, seed=3, length=20)]
    rows_ = [(12 * m + i, k, v) for i, k, v in base for m in range(1 + i % 4)] + [(900 + i, k, 1.0) for i in range(3) for k in range(20)]
    ids = spark.createDataFrame(sorted({(r[0],) for r in rows_}), "itemid long")
    history = spark.createDataFrame([(i, 600 * k, v) for i, k, v in rows_], schemas.HISTORY)
    onsets = spark.createDataFrame([(i, 20_000 * (i // 24)) for (i,) in {(r[0],) for r in rows_} if i % 3], "itemid long, onset long")
    charts = spark.createDataFrame(rows_, "itemid long, bucket long, value double")
    classes = cluster._classes(cluster._series(charts, 3))[0]
    assert {r.itemid: r.n for r in classes.collect()} == {i: 1 + i % 4 for i in range(12)} | {900 + i: 1 for i in range(3)}
    for linkage, least, most in (("complete", 2, 5000), ("complete", 4, 2), ("average", 3, 5000), ("dbscan", 4, 5000), ("dbscan", 4, 2)):
        cfg = config.Clustering(linkage=linkage, corr_eps=0.3, min_samples=least, max_items=most)
        whole = cluster.onset_constraint(cluster.pair_distances(charts), onsets, cfg.max_onset_gap)
        want = rows(cluster.group_items(whole, replace(cfg, max_items=5000), ids), "itemid", "clusterid")
        assert rows(cluster.cluster_anomalies(history, ids, cfg, None, onsets), "itemid", "clusterid") == want and len({c for _, c in want}) > 2


def test_groups_distances_by_pieces(monkeypatch):
    """The furthest items of two groups, by pieces that cut groups: flat series, families and onsets included."""
    n, rng = 40, np.random.default_rng(2)
    ranks = lambda k: 2 * rng.random((n, k)).argsort(axis=1).argsort(axis=1) + 1
    rows_ = pd.DataFrame({"itemid": range(n), "d": list(ranks(9)), "l": list(ranks(10)), "f": [None if i % 7 == 0 else f"k{i % 3}" for i in range(n)], "o": [i * 10.0 if i % 2 else None for i in range(n)]})
    rows_.loc[[3, 4], "d"] = None
    rows_.loc[[4, 5], "l"] = None
    whole = cluster._whole_side(rows_)
    d = cluster._between(whole, whole, 0.2, 200)
    assert set(d[3, [0, 2, 4]]) == {0.5} and d[1, 25] == 1 and (d[whole.f[:, None] == whole.f[None, :]] <= 0.5).sum() > 10
    left, right = (np.sort(rng.integers(0, k, n)) for k in (6, 11))
    left, right = (np.unique(x, return_inverse=True)[1] for x in (left, right))
    want = [[d[np.ix_(left == i, right == j)].max() for j in range(right[-1] + 1)] for i in range(left[-1] + 1)]
    for piece in (7, 1024):
        monkeypatch.setattr(cluster, "PIECE", piece)
        assert (cluster._furthest(whole, whole, left, right, 0.2, 200) == want).all()


def test_series_are_linked_without_their_pairs(spark, monkeypatch):
    """Beyond `max_items` at a wide eps: the groups of one matrix, and no table has the close pairs of all items."""
    n, written, write = 240, [], cluster.materialize
    rows_ = series(n, 12, 1.2, length=20) + [(n + i, k, v) for i, k, v in series(20, 12, 1.2, length=20)]
    history = spark.createDataFrame([(i, 600 * k, v) for i, k, v in rows_], schemas.HISTORY)
    ids = spark.range(n + 20).withColumnRenamed("id", "itemid")
    keys = ids.select("itemid", F.concat(F.lit("k"), (F.col("itemid") % 20 % 3).cast("string"), F.lit("[x]")).alias("key_"))
    onsets = ids.where("itemid % 20 > 4").select("itemid", F.when(F.col("itemid") % 20 % 6 < 3, 0).otherwise(50_000).cast("long").alias("onset"))

    def kept(df, name):
        out = write(df, name)
        written.append((out.count(), name))
        return out

    cfg = config.Clustering(corr_eps=0.45, raw_corr_min=0.3, min_samples=3)
    want = rows(cluster.cluster_anomalies(history, ids, cfg, keys, onsets), "itemid", "clusterid")
    monkeypatch.setattr(cluster, "materialize", kept)
    got = rows(cluster.cluster_anomalies(history, ids, replace(cfg, max_items=60), keys, onsets), "itemid", "clusterid")
    assert sorted(got) == sorted(want) and len({c for _, c in want}) > 12 and len(got) == n + 20
    assert max(k for k, name in written if name not in ("flagged-samples", "charts")) <= 60 * 59 / 2 + 60


def test_the_index_compares_few_pairs(spark):
    """5,000 series of 40 incidents: the same close pairs as one matrix, under a tenth of the pairs compared."""
    n, groups, eps = 5000, 40, 0.2
    rng = np.random.default_rng(3)
    x = rng.standard_normal((groups, 60))[np.arange(n) % groups] + 0.3 * rng.standard_normal((n, 60))
    ranks = x.argsort(axis=1).argsort(axis=1).astype(float)
    vectors = spark.createDataFrame([(i, "", v.tolist()) for i, v in enumerate(ranks)], "itemid long, f string, v array<double>")
    blocks = cluster.index_blocks(vectors, 1 - 2 * eps, cluster._pivots(vectors))
    sizes = blocks.groupBy("a", "b").agg(F.count_if("own").alias("l"), F.count_if(~F.col("own")).alias("r")).collect()
    compared = sum(s.l * (s.l - 1) // 2 if s.a == s.b else s.l * s.r for s in sizes)
    assert compared < 0.1 * n * (n - 1) / 2
    c = (ranks - ranks.mean(axis=1, keepdims=True)) / ranks.std(axis=1, keepdims=True) / np.sqrt(60)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(c @ c.T >= 1 - 2 * eps, 1)))}
    flat = vectors.select("itemid", F.posexplode("v").alias("bucket", "r"))
    got = {(r.i, r.j) for r in cluster.close_correlation(flat, 1 - 2 * eps).collect()}
    assert got == want and len(got) > 100_000


def test_linkage_in_rounds_equals_one_matrix(spark):
    """2,000 items with many equal distances, and smaller sets, by rounds and in one task."""
    rng = np.random.default_rng(11)
    for n, per in ((40, 40), (2000, 50)):
        rows_, whole = [], {}
        for lo in range(0, n, per):
            d = rng.integers(1, 12, (per, per)) / 20
            d = np.minimum(d, d.T)
            rows_ += [(lo + i, lo + j, float(d[i, j])) for i in range(per) for j in range(i + 1, per) if d[i, j] < 0.5]
            d[d >= 0.5] = np.inf
            np.fill_diagonal(d, 0)
            whole |= {lo + i: lo + int(x) for i, x in enumerate(cluster.agglomerate(d, 0.5, "complete"))}
        pairs = spark.createDataFrame(rows_, "i long, j long, distance double")
        got = {r.itemid: r.lead for r in cluster.link_rounds(pairs).collect()}
        assert got == {k: v for k, v in whole.items() if k in got} and all(whole[k] == k for k in whole.keys() - got.keys())


def test_components_beyond_one_task(spark):
    n = 60
    rng = np.random.default_rng(13)
    d = rng.integers(1, 30, (n, n)) / 30
    d = np.minimum(d, d.T)
    pairs = spark.createDataFrame([(3 * i, 3 * j, float(d[i, j])) for i in range(n) for j in range(i + 1, n)], "i long, j long, distance double")
    for linkage, least in (("complete", 2), ("dbscan", 4), ("dbscan", 6)):
        cfg = config.Clustering(linkage=linkage, corr_eps=0.08, min_samples=least)
        one = sorted(rows(cluster.group_items(pairs, cfg), "itemid", "clusterid"))
        assert sorted(rows(cluster.group_items(pairs, replace(cfg, max_items=5)), "itemid", "clusterid")) == one and len(one) == n


def test_groups_against_one_matrix(spark):
    """Linkage by components gives what the whole matrix gives."""
    rng = np.random.default_rng(7)
    n = 24
    d = rng.random((n, n))
    d = (d + d.T) / 2
    pairs = spark.createDataFrame([(10 * i, 10 * j, float(d[i, j])) for i in range(n) for j in range(i + 1, n)], "i long, j long, distance double")
    for linkage in ("complete", "average", "dbscan"):
        cfg = config.Clustering(linkage=linkage, corr_eps=0.25)
        np.fill_diagonal(d, 0)
        whole = cluster.density(d, 0.25, 2) if linkage == "dbscan" else cluster.agglomerate(d, 0.25, linkage)
        groups = {frozenset((10 * np.flatnonzero(whole == x)).tolist()) for x in set(whole.tolist()) if x >= 0 and (whole == x).sum() > 1}
        got = dict(rows(cluster.group_items(pairs, cfg), "itemid", "clusterid"))
        assert len(got) == n and {frozenset(i for i, c in got.items() if c == x) for x in set(got.values()) if x >= 0} == groups
        leads = sorted(min(g) for g in groups)
        assert all(got[x] == k for k, x in enumerate(leads))


def test_day_tables(spark, tmp_path):
    st = Stores(spark, f"file://{tmp_path}", "ds")
    st.init()
    day = 86400
    st.history.upsert(spark.createDataFrame([(1, 5, 1.0), (1, day + 5, 2.0), (2, 2 * day, 3.0)], schemas.HISTORY))
    before = {d: t.versions() for d, t in st.history.days().items()}
    st.history.upsert(spark.createDataFrame([(1, day + 5, 9.0)], schemas.HISTORY))
    after = {d: t.versions() for d, t in st.history.days().items()}
    assert [d for d in after if after[d] != before[d]] == [1] and rows(st.history.read(), "value") == [(1.0,), (3.0,), (9.0,)]
    st.history.delete_before("clock", day + 6)
    assert rows(st.history.read(), "value") == [(3.0,)] and 0 not in st.history.days()
    st.history.replace(spark.createDataFrame([(7, 0, 1.0)], schemas.HISTORY))
    assert rows(st.history.read(), "itemid") == [(7,)]


def test_database(spark, tmp_path):
    """A real database by way of JDBC: pushed ids, ranges, versions, retries."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    put = lambda df, name: df.toDF(*map(str.upper, df.columns)).write.jdbc(url, name, mode="append", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    put(spark.createDataFrame([(1, "h1"), (2, "h2")], "hostid long, name string"), "hosts")
    put(spark.createDataFrame([(i, 1 + i % 2, f"k{i}", f"n{i}", "B") for i in range(10)], "itemid long, hostid long, key_ string, name string, units string"), "items")
    put(spark.createDataFrame([(1, 5), (2, 5)], "hostid long, groupid long"), "hosts_groups")
    put(spark.createDataFrame([(5, "g/x")], "groupid long, name string"), "groups")
    put(spark.createDataFrame([(3000000,)], "mandatory long"), "dbversion")
    put(spark.createDataFrame([(i, 100 + i, 0.5 + i) for i in range(10)], "itemid long, clock int, value double"), "history")
    put(spark.createDataFrame([(i, 200 + i, i) for i in range(10)], "itemid long, clock int, value long"), "history_uint")
    plain = {"driver": "org.apache.derby.jdbc.EmbeddedDriver", "delay": 0}
    src = JdbcSource(spark, config.Source(type="jdbc", url=url, options={**plain, "batch_size": 2, "partitions": 3}))
    assert src.schema_version() == "3000000" and rows(src.get_item_details(), "group_name")[0] == ("g/x",)
    ids = spark.createDataFrame([(3,), (4,), (8,)], "itemid long")
    some = src.get_history(103, 204, ids)
    assert rows(some, "itemid", "value") == [(3, 3.0), (3, 3.5), (4, 4.0), (4, 4.5), (8, 8.5)] and some.rdd.getNumPartitions() <= 4
    assert rows(src.get_history(0, 1000), "itemid") == sorted([(i,) for i in range(10)] * 2)
    gone = JdbcSource(spark, config.Source(type="jdbc", url=f"jdbc:derby:{tmp_path}/nowhere", options={**plain, "retries": 2}))
    with pytest.raises(Exception):  # noqa: B017
        gone.table("hosts")


def test_whole_cycle_with_stores(spark, tmp_path):
    end = 1_700_000_000 - 1_700_000_000 % 3600
    rng = np.random.default_rng(4)
    hist, trends = [], []
    for i in range(4):
        for h in range(14 * 24):
            t = end - 3600 * (14 * 24 - h)
            v = 100 + float(rng.normal(0, 3)) + (300 if i < 2 and t >= end - 7200 else 0)
            trends.append((i, t, v - 2, v, v + 2))
        for k in range(72):
            t = end - 600 * (71 - k)
            hist.append((i, t, 100 + float(rng.normal(0, 3)) + (300 if i < 2 and t >= end - 7200 else 0)))
    folder = f"file://{tmp_path}/data"
    for name, df in (("history", spark.createDataFrame(hist, schemas.HISTORY)), ("trends", spark.createDataFrame(trends, schemas.TRENDS)), ("items", spark.createDataFrame([("g", 1, "h", i, f"k{i}", "") for i in range(4)], "group_name string, hostid long, host_name string, itemid long, item_name string, units string"))):
        write_csv(df, f"{folder}/{name}.csv.gz")
    cfg = config.Source(data_dir=folder)
    src, st = CsvSource(spark, cfg), Stores(spark, f"file://{tmp_path}/wh", "ds")
    st.create()
    cycle.update_statistics(spark, src, st, cfg, end)
    assert rows(cycle.run_detection(spark, src, st, cfg, end), "itemid") == [(0,), (1,)]
    found = st.read_anomalies().collect()
    assert {(r.itemid, r.created, r.rescued) for r in found} == {(0, end, False), (1, end, False)} and all(r.score >= 0.7 for r in found)
    assert cycle.run_detection(spark, src, st, cfg, end + 600).count() == 0
    stores.export_anomalies(st.read_anomalies(), f"file://{tmp_path}/out")
    assert len((tmp_path / "out/anomalies.csv").read_text().splitlines()) == 3
    stores.export_dataset(src, None, 0, 0, end, f"file://{tmp_path}/copy", [end])
    again = CsvSource(spark, config.Source(data_dir=f"file://{tmp_path}/copy"))
    assert again.get_history(0, end).count() == len(hist) and (tmp_path / "copy/cycles.txt").read_text() == f"{end}\n"
    picked = spark.createDataFrame([(1, 0.9), (2, 0.0)], "itemid long, score double")
    stores.export_labels(picked, f"file://{tmp_path}/out")
    assert (tmp_path / "out/labels.csv").read_text().splitlines()[0] == "item_id,label,note"
    assert stores.write_skeleton_labels(picked, f"file://{tmp_path}/out/new.csv") and not stores.write_skeleton_labels(picked, f"file://{tmp_path}/out/new.csv")


def test_streams(spark, tmp_path):
    schema = "itemid long, clock long, value double"
    end = 1_700_000_000
    spark.createDataFrame([(i, end - 60 * k, (50.0 if i == 1 and k < 3 else 10.0) + k % 2) for i in range(3) for k in range(60)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    out = stream.trailing_window_stats(read(), 3600, 600, 0).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.table("windows").where("itemid = 1").agg(F.max("max_value")).first()[0] == 51.0
    once = stream.detect_once(read(), 7200).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    once.awaitTermination()
    assert rows(spark.table("once"), "itemid") == [(0,), (1,), (2,)]
    items = spark.createDataFrame([("g", 1, "h", i, f"k{i}", "", f"k{i}") for i in range(3)], schemas.ITEMS)
    cfg = config.Source(fast_detect=config.FastDetect(True, (config.WatchRule(),), 3600, 3, 3.0, 0.5, False, 3.0, False, False, 0))
    got = []
    q = stream.start_fast_axis(read(), lambda a, b: spark.read.parquet(f"{tmp_path}/in"), items, None, cfg, lambda e, t: got.append((t, [r["items"][0].item_id for r in e.collect()])), f"{tmp_path}/cp")
    q.awaitTermination()
    assert got == [(end, [1])]
