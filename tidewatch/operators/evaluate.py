"""Scores and clusters against labels: 1 anomaly, 0 normal, -1 unknown (never counted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = tuple(round(0.05 * k, 2) for k in range(1, 20))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _f1(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def labelled(scores: DataFrame, labels: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(itemid, label, score, weight) of the known labels; an item without a score has 0."""
    j = labels.where("label >= 0").select(F.col("item_id").alias("itemid"), "label").join(scores.select("itemid", "score"), "itemid", "left").fillna({"score": 0.0})
    if weights is None:
        return j.withColumn("weight", F.lit(1.0))
    return j.join(weights.select("itemid", "weight"), "itemid", "left").fillna({"weight": 1.0})


def confusion(rows: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, weighted_recall and weighted_f1 for each value of `by`."""
    pos = F.col("label") == 1
    one = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    agg = rows.groupBy(*by).agg(
        one(hit & pos).alias("tp"), one(hit & ~pos).alias("fp"), one(~hit & pos).alias("fn"), one(~hit & ~pos).alias("tn"),
        F.sum(F.when(hit & pos, F.col("weight")).otherwise(0.0)).alias("_wtp"), F.sum(F.when(pos, F.col("weight")).otherwise(0.0)).alias("_wp"),
    )
    agg = agg.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    agg = agg.withColumn("f1", _f1(F.col("precision"), F.col("recall"))).withColumn("weighted_recall", _ratio(F.col("_wtp"), F.col("_wp")))
    return agg.withColumn("weighted_f1", _f1(F.col("precision"), F.col("weighted_recall"))).drop("_wtp", "_wp")


def detection_metrics(scores: DataFrame, labels: DataFrame, threshold: float = 0.5, weights: DataFrame | None = None) -> DataFrame:
    return confusion(labelled(scores, labels, weights), [], F.col("score") >= threshold)


def category_metrics(scores: DataFrame, labels: DataFrame, categories: DataFrame, threshold: float = 0.5, weights: DataFrame | None = None) -> DataFrame:
    rows = labelled(scores, labels, weights).join(categories.select("itemid", "category"), "itemid", "left").fillna({"category": "default"})
    return confusion(rows, ["category"], F.col("score") >= threshold)


def detector_metrics(scores: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The metrics of each detector's own scores; `scores` has (itemid, detector, score)."""
    known = labels.where("label >= 0").select(F.col("item_id").alias("itemid"), "label")
    rows = known.join(scores.select("detector").distinct(), F.lit(True))
    rows = rows.join(scores, ["itemid", "detector"], "left").fillna({"score": 0.0}).withColumn("weight", F.lit(1.0))
    return confusion(rows, ["detector"], F.col("score") >= threshold)


def threshold_sweep(scores: DataFrame, labels: DataFrame, thresholds: tuple[float, ...] = GRID, weights: DataFrame | None = None) -> DataFrame:
    """The metrics at every threshold."""
    rows = labelled(scores, labels, weights).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return confusion(rows, ["threshold"], F.col("score") >= F.col("threshold"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of the highest f1, the lowest of equal ones."""
    return sweep.orderBy(F.col("f1").desc(), "threshold").limit(1)


def min_alert_threshold(sweep: DataFrame, target_recall: float = 0.95) -> DataFrame:
    """The highest threshold that reaches the weighted recall; else that of the highest recall, then of the fewest alerts."""
    ok = (F.col("weighted_recall") >= target_recall).cast("int")
    alerts = F.col("tp") + F.col("fp")
    return sweep.orderBy(ok.desc(), F.when(ok == 1, -F.col("threshold")), F.col("weighted_recall").desc(), alerts, "threshold").limit(1)


def cluster_metrics(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """Pair precision, recall and f1, adjusted Rand index, homogeneity, completeness and V of the incident-labelled items.

    All from the contingency table; an item in no cluster is a cluster of its own.
    """
    truth = labels.where("incident is not null and incident <> ''").select(F.col("item_id").alias("itemid"), F.col("incident").alias("t"))
    rows = truth.join(clusters, "itemid").select("t", F.when(F.col("clusterid") >= 0, F.concat(F.lit("c"), "clusterid")).otherwise(F.concat(F.lit("i"), "itemid")).alias("p"))
    cells = rows.groupBy("t", "p").agg(F.count("*").cast("double").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias(f"pairs_{c}"), F.coalesce(F.sum(F.col("n") * F.log("n")), F.lit(0.0)).alias(f"h_{c}"))
    both = cells.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("tp"), F.coalesce(F.sum(F.col("n") * F.log("n")), F.lit(0.0)).alias("h_tp"))
    j = both.crossJoin(side("t")).crossJoin(side("p"))  # one row each
    n, tp, pt, pp = (F.col(c) for c in ("n", "tp", "pairs_t", "pairs_p"))
    j = j.withColumn("pair_precision", _ratio(tp, pp)).withColumn("pair_recall", _ratio(tp, pt)).withColumn("pair_f1", _f1(F.col("pair_precision"), F.col("pair_recall")))
    chance = _ratio(pt * pp, pairs(n))
    top = (pt + pp) / 2 - chance
    j = j.withColumn("ari", F.when(n < 2, 0.0).when(top == 0, 1.0).otherwise((tp - chance) / F.nullif(top, F.lit(0.0))))
    entropy = lambda h: F.when(n > 0, F.log(n) - F.col(h) / n).otherwise(0.0)
    mutual = entropy("h_t") + entropy("h_p") - entropy("h_tp")
    part = lambda h: F.when(n < 2, 0.0).when(entropy(h) <= 1e-12, 1.0).otherwise(mutual / F.nullif(entropy(h), F.lit(0.0)))
    j = j.withColumn("homogeneity", part("h_t")).withColumn("completeness", part("h_p")).withColumn("v_measure", _f1(F.col("homogeneity"), F.col("completeness")))
    return j.select(n.cast("long").alias("n_items"), tp.cast("long").alias("pair_tp"), (pp - tp).cast("long").alias("pair_fp"), (pt - tp).cast("long").alias("pair_fn"), "pair_precision", "pair_recall", "pair_f1", "ari", "homogeneity", "completeness", "v_measure")


def pool(reports: DataFrame) -> DataFrame:
    """Micro (pooled counts) and macro (mean of ratios) averages of several data sets' reports."""
    s = reports.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn")), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    s = s.withColumn("micro_precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("micro_recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("micro_f1", _f1(F.col("micro_precision"), F.col("micro_recall")))
