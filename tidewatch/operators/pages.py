"""Dashboard pages and review queues as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import keep_latest
from .fast import event_order

#: The dashboard's grid.
COLUMNS, ROWS = 4, 12
WIDGET_WIDTH, WIDGET_HEIGHT = 15, 5


def hash_order(item: Column, seed: int) -> Column:
    """A fixed pseudo-random order of ids that every SQL engine computes alike: two steps of modular arithmetic."""
    a = F.pmod(item * 48271 + seed * 7919, F.lit(2147483647))
    return F.pmod(a * 16807 + 12345, F.lit(2147483647))


def pages_by_group(anomalies: DataFrame) -> DataFrame:
    """(page, itemid): each group's anomalies, a cluster of a host by its lowest item."""
    key = ["group_name", "hostid", "clusterid", *(["created"] if "created" in anomalies.columns else [])]
    reps = anomalies.where("clusterid >= 0").groupBy(*key).agg(F.min("itemid").alias("itemid")).select(F.col("group_name").alias("page"), "itemid")
    alone = anomalies.where("clusterid < 0").select(F.col("group_name").alias("page"), "itemid")
    return reps.unionByName(alone).distinct()


def pages_by_cluster(anomalies: DataFrame, max_clusters: int = 50) -> DataFrame:
    """(page, itemid, pos): a page `cluster<n>` for each cluster of several items; clusters of one item and items of none
    share `singletons`. There are `max_clusters` pages at most, in the order of their clusters, none before all.

    Clusters of different cycles are told apart by the cycle's rank; pos is an item's place on its page.
    """
    rows = anomalies.select("hostid", "itemid", *(["created"] if "created" in anomalies.columns else []), F.coalesce("clusterid", F.lit(-1)).cast("long").alias("clusterid"))
    if "created" in anomalies.columns:
        # a row for each cycle: a short sort
        cycles = rows.select("created").distinct().withColumn("n", F.dense_rank().over(Window.orderBy("created")) - 1)
        rows = rows.join(cycles, "created").withColumn("clusterid", F.when(F.col("clusterid") >= 0, F.col("n") * 1000 + F.col("clusterid")).otherwise(-1))
    rows = rows.select(F.greatest("clusterid", F.lit(-1)).alias("cid"), "hostid", "itemid").distinct()
    sizes = rows.groupBy("cid").agg(F.count("*").alias("n"))
    page = F.when((F.col("cid") >= 0) & (F.col("n") > 1), F.concat(F.lit("cluster"), "cid")).otherwise("singletons")
    rows = rows.join(sizes, "cid").select(page.alias("page"), "cid", "hostid", "itemid")
    shown = rows.groupBy("page").agg(F.min("cid").alias("first")).orderBy("first").limit(max_clusters).select("page")
    pos = F.row_number().over(Window.partitionBy("page").orderBy("cid", "hostid", "itemid")) - 1
    return rows.join(shown, "page").select("page", "itemid", pos.alias("pos"))


def pages_for_events(events: DataFrame) -> DataFrame:
    """(page, itemid, pos) of the fast axis' events, numbered from 1 in the order of their document; events without items have
    no page."""
    # a handful of events: their order is one short sort
    ranked = events.withColumn("k", F.row_number().over(Window.orderBy(*event_order(events))))
    name = F.concat(F.lit("event"), "k", F.when(F.col("cluster") >= 0, F.concat(F.lit("_cluster"), "cluster")).otherwise(""))
    return ranked.select(name.alias("page"), F.posexplode("items").alias("pos", "x")).select("page", F.col("x.item_id").alias("itemid"), "pos")


#: The review dashboard's pages in their order, by band, and its widgets' width.
BAND_PAGES = (("high", "high_score"), ("mid", "mid_score"), ("low", "low_score"))
REVIEW_WIDTH = 16


def pages_by_band(scores: DataFrame) -> DataFrame:
    """(page, itemid, pos) of scored items for review: a page for each band, highest scores first."""
    page = F.coalesce(*(F.when(F.col("band") == band, name) for band, name in BAND_PAGES))
    pos = F.row_number().over(Window.partitionBy("page").orderBy(F.col("score").desc(), "itemid")) - 1
    return scores.withColumn("page", page).where("page is not null").select("page", "itemid", pos.alias("pos"))


def page_layout(pages: DataFrame, labels: DataFrame | None = None, ncols: int = COLUMNS, nrows: int = ROWS, width: int = WIDGET_WIDTH, suffix_always: bool = True) -> DataFrame:
    """(page, itemid, x, y, header): widgets on a grid; page p becomes p_1, p_2, .. as they fill. Without `suffix_always`, a
    page that one grid holds keeps its name. Items stand in the order of `pos`, or else of itemid."""
    per = ncols * nrows
    order = ["pos"] if "pos" in pages.columns else ["itemid"]
    k = F.row_number().over(Window.partitionBy("page").orderBy(*order)) - 1
    rows = pages.withColumn("k", k).withColumn("n", F.floor(F.col("k") / per) + 1).withColumn("r", F.pmod("k", F.lit(per)))
    rows = rows.withColumn("all", F.count("*").over(Window.partitionBy("page")))
    rows = rows.join(labels, "itemid", "left") if labels is not None else rows.withColumn("header", F.lit(""))
    numbered = F.concat_ws("_", "page", F.col("n").cast("string"))
    page = numbered if suffix_always else F.when(F.col("all") > per, numbered).otherwise(F.col("page"))
    x, y = F.pmod("r", F.lit(ncols)) * width, F.floor(F.col("r") / ncols) * WIDGET_HEIGHT
    return rows.select(page.alias("page"), "itemid", x.cast("long").alias("x"), y.cast("long").alias("y"), F.coalesce("header", F.lit("")).alias("header"))


def widget_labels(items: DataFrame) -> DataFrame:
    """(itemid, header): host and key."""
    return items.select("itemid", F.concat_ws(": ", "host_name", "key_").alias("header"))


def latest_cycle(anomalies: DataFrame) -> DataFrame:
    """Rows of the newest cycle; all of them if cycles aren't told apart."""
    if "created" not in anomalies.columns:
        return anomalies
    return anomalies.join(F.broadcast(anomalies.agg(F.max("created").alias("created"))), "created", "left_semi")  # one row


def collapse_flagged(anomalies: DataFrame) -> DataFrame:
    """One row for each cluster (its best item) and each item in none, with n_members and n_rescued."""
    best = keep_latest(anomalies, ["itemid"], F.col("score").desc(), F.col("created").desc(), "group_name")
    group = F.when(F.col("clusterid") >= 0, F.concat(F.lit("c"), "clusterid")).otherwise(F.concat(F.lit("i"), "itemid"))
    best = best.withColumn("_g", group)
    sizes = best.groupBy("_g").agg(F.count("*").alias("n_members"), F.count_if("rescued").alias("n_rescued"))
    return keep_latest(best, ["_g"], F.col("score").desc(), "itemid").join(sizes, "_g").drop("_g")


def top_zscores(scores: DataFrame, n: int) -> DataFrame:
    return scores.orderBy(F.col("score").desc(), F.col("z").desc(), "itemid").limit(max(n, 0)).select("itemid", "score", "z")


def candidate_pools(scores: DataFrame, flagged: DataFrame, n_mid: int, n_random: int, seed: int, oversample: int = 3) -> DataFrame:
    """(itemid, score, band, pos): the highest scores of the middle band, and low ones in a fixed random order."""
    rest = scores.join(flagged.select("itemid"), "itemid", "left_anti").select("itemid", "score")
    w = lambda *o: Window.partitionBy("band").orderBy(*o)
    band = F.when((F.col("score") > 0.1) & (F.col("score") < 0.5), "mid").when(F.col("score") <= 0.1, "low")
    rest = rest.withColumn("band", band).where("band is not null")
    order = F.when(F.col("band") == "mid", -F.col("score")).otherwise(hash_order(F.col("itemid"), seed).cast("double"))
    n = F.when(F.col("band") == "mid", n_mid * oversample).otherwise(n_random * oversample)
    return rest.withColumn("pos", F.row_number().over(w(order, "itemid"))).where(F.col("pos") <= n)


def dedup_trim(pool: DataFrame, items: DataFrame, excluded: DataFrame, n: int) -> DataFrame:
    """The first `n` of each band that have metadata and aren't labelled yet."""
    known = pool.join(items.select("itemid", "host_name", "key_"), "itemid").join(excluded.select("host_name", "key_").distinct(), ["host_name", "key_"], "left_anti")
    w = Window.partitionBy("band").orderBy("pos")
    return known.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select("itemid", "score", "band", "host_name", "key_", "rn")


def stratified_sample(scored: DataFrame, unscored: DataFrame, n_top: int, n_mid: int, n_random: int, seed: int) -> DataFrame:
    """(itemid, score): the top scores, some of the rest and some unscored items (score 0), in a fixed random order."""
    top = scored.select("itemid", "score").orderBy(F.col("score").desc(), "itemid").limit(n_top)
    rest = scored.select("itemid", "score").join(top, "itemid", "left_anti").orderBy(hash_order(F.col("itemid"), seed), "itemid").limit(n_mid).select("itemid", "score")
    rand = unscored.select("itemid").orderBy(hash_order(F.col("itemid"), seed + 1), "itemid").limit(n_random).withColumn("score", F.lit(0.0))
    return top.unionByName(rest).unionByName(rand)


#: What each stratum of the queue is called, by the pools' bands.
STRATA = {"mid": ("boundary", "near threshold"), "low": ("control", "random normal control")}


def review_queue(scores: DataFrame, items: DataFrame, excluded: DataFrame, n_flagged: int, n_mid: int, n_random: int, seed: int, zscores: DataFrame | None = None, anomalies: DataFrame | None = None) -> DataFrame:
    """The queue for review: (itemid, host_name, key_, score, band, clusterid, reason).

    Its strata: flagged (the highest first-stage z-scores, or with `anomalies` one row for each incident of their newest
    cycle), boundary and control. What is `excluded` (host_name, key_) is in none.
    """
    known = items.select("itemid", "host_name", "key_")
    done = excluded.select("host_name", "key_").distinct()
    if anomalies is None:
        top = top_zscores(zscores, 3 * n_flagged)
        flagged = top.select("itemid", "score", F.format_string("first-stage z=%.1f", "z").alias("reason"), F.col("z").alias("rank"), F.lit(-1).alias("clusterid"))
        hits = flagged.select("itemid")
    else:
        one = collapse_flagged(latest_cycle(anomalies))
        text = F.when(F.col("clusterid") >= 0, F.format_string("incident cluster %d (%d items, %d rescued)", "clusterid", "n_members", "n_rescued")).otherwise("flagged (unclustered)")
        flagged = one.select("itemid", "score", text.alias("reason"), F.col("score").alias("rank"), "clusterid")
        hits = flagged.join(known, "itemid").join(done, ["host_name", "key_"], "left_anti").select("itemid")
    flagged = flagged.join(known, "itemid").join(done, ["host_name", "key_"], "left_anti")
    if anomalies is None:
        flagged = flagged.orderBy(F.col("score").desc(), F.col("rank").desc(), "itemid").limit(n_flagged)
    pool = candidate_pools(scores, hits, n_mid, n_random, seed)
    some = dedup_trim(pool, items, excluded, max(n_mid, n_random)).where(F.col("rn") <= F.when(F.col("band") == "mid", n_mid).otherwise(n_random))
    named = F.create_map(*(F.lit(x) for k, (band, _) in STRATA.items() for x in (k, band)))[F.col("band")]
    reason = F.create_map(*(F.lit(x) for k, (_, why) in STRATA.items() for x in (k, why)))[F.col("band")]
    rest = some.select("itemid", "host_name", "key_", F.round("score", 4).alias("score"), named.alias("band"), F.lit(-1).alias("clusterid"), reason.alias("reason"))
    return flagged.select("itemid", "host_name", "key_", F.round("score", 4).alias("score"), F.lit("flagged").alias("band"), "clusterid", "reason").unionByName(rest)


def replay_candidates(recorded: DataFrame, scores: DataFrame, span_start: int) -> DataFrame:
    """(itemid) worth replaying: recorded since `span_start`, or scored above zero by the cheap detectors."""
    return recorded.where(F.col("created") >= span_start).select("itemid").unionByName(scores.where("score > 0").select("itemid")).distinct()


def build_master_rows(labels: DataFrame, items: DataFrame, date: str) -> DataFrame:
    """Labels with their item's host and key; labels of unknown items are left out."""
    j = labels.join(items.select(F.col("itemid").alias("item_id"), "host_name", "key_"), "item_id", "left").dropna(subset=["host_name", "key_"])
    return j.select("host_name", "key_", "label", "note", "incident", "confidence", F.lit(date).alias("date"))


def upsert_master(master: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (host_name, key_): the new one, else the old one."""
    both = master.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_latest(both, ["host_name", "key_"], F.col("_new").desc(), F.col("date").desc_nulls_last(), F.col("label").desc_nulls_last()).drop("_new")


def review_summary(anomalies: DataFrame, items: DataFrame, scores: DataFrame) -> DataFrame:
    """Each known item once: its newest anomaly, all cycles that found it, its score and band."""
    newest = keep_latest(anomalies, ["itemid"], F.col("created").desc(), F.col("score").desc()).select("itemid", "created", "clusterid", "trend_mean", "trend_std")
    cycles = anomalies.groupBy("itemid").agg(F.array_sort(F.collect_set("created")).alias("detections"))
    j = items.select("itemid", "host_name", "item_name", "group_name").join(newest, "itemid", "left").join(cycles, "itemid", "left").join(scores.select("itemid", "score", "band"), "itemid", "left")
    return j.fillna({"score": 0.0, "band": "low"}).withColumn("detections", F.coalesce("detections", F.array().cast("array<long>")))


def normalize_labels(labels: DataFrame) -> DataFrame:
    """Labels as integers of 1, 0, -1 and confidences in [0, 1] (1 if missing or no number)."""
    c = F.expr("try_cast(confidence as double)")
    fixed = F.when(c.isNull() | F.isnan(c), 1.0).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    return labels.select("item_id", F.coalesce(F.expr("try_cast(label as int)"), F.lit(-1)).alias("label"), F.coalesce("note", F.lit("")).alias("note"), F.coalesce("incident", F.lit("")).alias("incident"), fixed.alias("confidence"))


def labels_for_saving(labels: DataFrame) -> DataFrame:
    """Labels as they are written: a note from the label, confidence only for anomalies."""
    note = F.when(F.col("label") == 1, "anomaly").when(F.col("label") == 0, "normal").when(F.col("label") == -1, "skip").otherwise("")
    return labels.select("item_id", "label", note.alias("note"), "incident", F.when(F.col("label") == 1, F.col("confidence")).alias("confidence"))


def incident_names(labels: DataFrame) -> DataFrame:
    """One row (names): the distinct incidents, sorted."""
    return labels.where("incident <> ''").agg(F.array_sort(F.collect_set("incident")).alias("names"))


def dashboard_widgets(dashboards: DataFrame) -> DataFrame:
    """(kind, id) of the items and graphs that dashboard widgets show; `json` holds one dashboard of the monitoring API a row, its
    widgets on pages or, in older ones, on the dashboard itself."""
    widgets = "array<struct<type:string,fields:array<struct<name:string,value:string>>>>"
    board = F.from_json("json", f"pages array<struct<widgets:{widgets}>>, widgets {widgets}")
    paged = F.flatten(F.coalesce(F.transform(board["pages"], lambda p: F.coalesce(p["widgets"], F.array().cast(widgets))), F.array().cast(f"array<{widgets}>")))
    shown = F.when(F.size(paged) > 0, paged).otherwise(board["widgets"])
    widget = dashboards.select(F.explode(shown).alias("w")).where(F.col("w.type").isin("graph", "svggraph")).withColumn("id", F.monotonically_increasing_id())
    field = widget.select("id", F.explode("w.fields").alias("f")).select("id", "f.name", "f.value")
    simple = field.where("name = 'source_type' and value = '1'").select("id").distinct().withColumn("simple", F.lit(True))
    j = field.join(simple, "id", "left").where("rlike(value, '^[0-9]+$')")
    simple = F.coalesce("simple", F.lit(False))
    item = F.when(F.col("name").rlike(r"^itemid(\.\d+)?$") & simple, "item").when(F.col("name").rlike(r"^graphid(\.\d+)?$") & ~simple, "graph").when(F.col("name").rlike(r"^ds\..*itemids"), "item")
    return j.withColumn("kind", item).where("kind is not null").select("kind", F.col("value").cast("long").alias("id")).distinct()


def dashboard_items(dashboards: DataFrame, graph_items: DataFrame) -> DataFrame:
    """(itemid) of all items that dashboards show, by themselves or on a graph of `graph_items` (graphid, itemid)."""
    found = dashboard_widgets(dashboards)
    drawn = found.where("kind = 'graph'").select(F.col("id").alias("graphid")).join(graph_items, "graphid").select("itemid")
    return found.where("kind = 'item'").select(F.col("id").alias("itemid")).unionByName(drawn).distinct()
