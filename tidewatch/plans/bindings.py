"""The driver's tables seen as monitoring data, in Spark and as SQL.

Items are users, samples their events. Items with a number ending in 3 step up in the last day, so that there is
something to find; those ending in 7 idle at zero in the `idle` variant. The cycle ends at a fixed time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENDEP = 1706659199
DAY = 86400
DAYS = 14


def _clock(ts: str):
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * DAY + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("itemid"), "event_type", "value", _clock("ts").alias("clock"))


def _stepped():
    return F.col("value") * F.when((F.col("itemid") % 10 == 3) & (F.col("clock") > ENDEP - DAY), 8).otherwise(1)


def history(spark: SparkSession, sf_dir: str, value=None) -> DataFrame:
    """(itemid, clock, value), one row a key."""
    rows = raw_events(spark, sf_dir).withColumn("value", _stepped() if value is None else value)
    return rows.groupBy("itemid", "clock").agg(F.avg("value").alias("value"))


def idle_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir, F.when((F.col("itemid") % 10 == 7) & (F.col("event_id") % 10 < 9), 0.0).otherwise(F.col("value")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    users = raw_events(spark, sf_dir).select("itemid").distinct()
    n = read("nation").select(F.col("n_nationkey").alias("hostid"), F.col("n_name").alias("host_name"), F.col("n_regionkey").alias("r"))
    r = read("region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("group_name"))
    c = read("customer").select(F.col("c_custkey").alias("itemid"), F.col("c_nationkey").alias("hostid"), "c_mktsegment")
    seg = F.col("c_mktsegment")
    pick = lambda k, last: F.when(seg == "AUTOMOBILE", KEYS[0][k]).when(seg == "BUILDING", KEYS[1][k]).when(seg == "FURNITURE", KEYS[2][k]).when(seg == "HOUSEHOLD", KEYS[3][k]).otherwise(last)
    j = users.join(c, "itemid").join(n, "hostid").join(r, "r")
    return j.select("group_name", F.col("hostid").cast("long").alias("hostid"), "host_name", "itemid", pick(0, KEYS[4][0]).alias("item_name"), pick(1, KEYS[4][1]).alias("units"), pick(0, KEYS[4][0]).alias("key_"))


#: Key and unit by market segment.
KEYS = (("net.if.in[eth0]", "bps"), ("system.cpu.util[,idle]", "%"), ("vfs.fs.size[/,used]", "B"), ("proc.num[sshd]", ""), ("vm.memory.size[available]", "B"))


def problem_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir).where("event_type = 'error'").join(items(spark, sf_dir).select("itemid", "host_name"), "itemid")
    return e.select("event_id", "clock", "host_name", (F.col("event_id") % 6).cast("int").alias("severity"), F.lit("error").alias("name"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step as the label, the host as the incident; every 13th item is unknown."""
    hit = F.col("itemid") % 10 == 3
    label = F.when(F.col("itemid") % 13 == 5, -1).when(hit, 1).otherwise(0)
    return items(spark, sf_dir).select(F.col("itemid").alias("item_id"), label.alias("label"), F.lit("").alias("note"), F.when(hit, F.col("host_name")).otherwise("").alias("incident"), F.lit(1.0).alias("confidence"))


def anomalies(spark: SparkSession, sf_dir: str, scores: DataFrame) -> DataFrame:
    """Scores (itemid, created, score) as recorded anomalies: host number modulo 5 as the cluster of every third item."""
    j = scores.join(items(spark, sf_dir), "itemid")
    cluster = F.when(F.col("itemid") % 3 == 0, (F.col("hostid") % 5).cast("int")).otherwise(-1)
    return j.select("itemid", "created", "group_name", "hostid", cluster.alias("clusterid"), "host_name", "item_name", "score", (F.col("itemid") % 2 == 0).alias("rescued"))


_STEP = f"value * CASE WHEN itemid % 10 = 3 AND clock > {ENDEP - DAY} THEN 8 ELSE 1 END"
_case = lambda k: "CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN '{KEYS[i][k]}'" for i, s in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"))) + f" ELSE '{KEYS[4][k]}' END"


def stats_sql(source: str, value: str, start: int, end: int = ENDEP) -> str:
    return (
        f"SELECT *, sum / cnt AS mean, sqrt(greatest((sqr_sum - sum * sum / cnt) / greatest(cnt - 1, 1), 0)) AS std FROM "
        f"(SELECT itemid, sum({value}) AS sum, sum({value} * {value}) AS sqr_sum, count({value})::BIGINT AS cnt, max(clock) AS last_clock, "
        f"count(*) FILTER ({value} = 0)::BIGINT AS zero_cnt, max({value}) AS max_value FROM {source} WHERE clock BETWEEN {start} AND {end} GROUP BY itemid) WHERE cnt > 0"
    )


#: The same views as SQL; each may use those above it.
VIEWS = {
    "ev": "SELECT event_id, user_id AS itemid, event_type, value, epoch_us(ts) // 1000000 AS clock FROM events",
    "hist": f"SELECT itemid, clock, avg({_STEP}) AS value FROM ev GROUP BY itemid, clock",
    "idle_hist": "SELECT itemid, clock, avg(CASE WHEN itemid % 10 = 7 AND event_id % 10 < 9 THEN 0 ELSE value END) AS value FROM ev GROUP BY itemid, clock",
    "trends": "SELECT itemid, clock - clock % 3600 AS clock, min(value) AS value_min, avg(value) AS value_avg, max(value) AS value_max FROM hist GROUP BY ALL",
    "items": f"SELECT r_name AS group_name, n_nationkey::BIGINT AS hostid, n_name AS host_name, itemid, {_case(0)} AS item_name, {_case(1)} AS units, {_case(0)} AS key_ "
    "FROM (SELECT DISTINCT itemid FROM ev) JOIN customer ON c_custkey = itemid JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
    "problems": "SELECT event_id, clock, host_name, (event_id % 6)::INTEGER AS severity, 'error' AS name FROM ev JOIN items USING (itemid) WHERE event_type = 'error'",
    "labels_": "SELECT itemid AS item_id, CASE WHEN itemid % 13 = 5 THEN -1 WHEN itemid % 10 = 3 THEN 1 ELSE 0 END AS label, CASE WHEN itemid % 10 = 3 THEN host_name ELSE '' END AS incident FROM items",
    "recent": stats_sql("hist", "value", ENDEP - DAY),
    "before": stats_sql("hist", "value", ENDEP - 2 * DAY, ENDEP - DAY),
    "base": stats_sql("trends", "value_avg", ENDEP - DAYS * DAY),
    "intra": f"SELECT itemid, avg(greatest(value_max - value_min, 0)) / 4.0 AS intra_std FROM trends WHERE clock BETWEEN {ENDEP - DAYS * DAY} AND {ENDEP} GROUP BY itemid",
    "sig": "SELECT base.*, intra_std, CASE WHEN intra_std > 0 THEN sqrt(std * std + intra_std * intra_std) ELSE std END AS sigma FROM base LEFT JOIN intra USING (itemid)",
    "hours": f"SELECT itemid, ((clock % 86400) // 3600)::SMALLINT AS hour_of_day, avg(value_avg) AS mean, coalesce(stddev_samp(value_avg), 0) AS std, count(value_avg)::BIGINT AS cnt FROM trends WHERE clock BETWEEN {ENDEP - DAYS * DAY} AND {ENDEP} GROUP BY ALL",
    "gaps": "SELECT itemid, clock - lag(clock) OVER (PARTITION BY itemid ORDER BY clock) AS gap FROM hist",
    "spacing": "SELECT itemid, greatest(round_even(coalesce(quantile_cont(gap, 0.5) FILTER (gap > 0), 600), 0)::BIGINT, 1) AS interval FROM gaps GROUP BY itemid",
}


def with_views(body: str, **more: str) -> str:
    """`body` with the views that it uses, directly or not."""
    have = {**VIEWS, **more}
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in have:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                visit(have[name])

    visit(body)
    ctes = ",\n".join(f"{n} AS ({q})" if "UNION ALL" in q and f"FROM {n} " in q else f"{n} AS MATERIALIZED ({q})" for n, q in have.items() if n in used)
    return f"WITH RECURSIVE {ctes}\n{body}" if ctes else body
