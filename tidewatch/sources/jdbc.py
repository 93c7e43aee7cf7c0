"""A monitoring database over JDBC: the tables hosts, items, groups, history and events, joined in Spark.

Time and item predicates are pushed to the database by Spark; names are column expressions, so wildcards in names are
only those of the pattern.
"""

from __future__ import annotations

import logging
import re
import time
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Source
from ..functions.sequence import keep_latest
from ..operators.stats import in_range
from .files import any_glob, restrict

log = logging.getLogger(__name__)
_OWN_OPTIONS = ("reader", "schema_version", "retries", "delay", "batch_size", "partitions")
#: Ids that are sent with the queries at most; more are joined in Spark.
PUSHED_IDS = 10_000


def name_matches(column: Column, patterns) -> Column:
    """Any of the patterns, in which only a star is a wildcard; a plain name also stands for the groups nested below it."""
    star = lambda p: column.rlike("(?s)^" + ".*".join(map(re.escape, p.split("*"))) + r"\z")
    one = lambda p: star(p) if "*" in p else (column == p) | column.startswith(p + "/")
    return reduce(lambda a, b: a | b, map(one, patterns), F.lit(not patterns))


class JdbcSource:
    """`options` may name a `reader`: a function from table name to frame, in place of JDBC (tests, other catalogs)."""

    def __init__(self, spark: SparkSession, cfg: Source):
        self.spark, self.cfg = spark, cfg
        self._reader = cfg.options.get("reader")
        self._version: str | None = str(cfg.options["schema_version"]) if cfg.options.get("schema_version") else None

    def _retried(self, load):
        """Tries again after a failed connection: options `retries` (3) and `delay` (seconds, 2)."""
        left = int(self.cfg.options.get("retries", 3))
        while True:
            try:
                return load()
            except Py4JJavaError:
                left -= 1
                if left <= 0:
                    raise
                log.warning("the database can't be reached; %d more attempts", left)
                time.sleep(float(self.cfg.options.get("delay", 2)))

    def table(self, name: str, where: list[str] | None = None, **more: str) -> DataFrame:
        """A table; with `where`, one partition and one query for each of these predicates."""
        if self._reader:
            return self._reader(name)
        options = {k: str(v) for k, v in self.cfg.options.items() if k not in _OWN_OPTIONS} | more
        if where is not None:
            return self._retried(lambda: self.spark.read.jdbc(self.cfg.url, name, predicates=where, properties=options))
        return self._retried(lambda: self.spark.read.format("jdbc").options(url=self.cfg.url, dbtable=name, **options).load())

    def schema_version(self) -> str:
        """The mandatory schema version, asked for once unless the options name it."""
        if self._version is None:
            self._version = str(self.table("dbversion").select("mandatory").first()[0])
        return self._version

    def _groups(self) -> str:
        """The table of groups: another one in schema 3. A reader of tables needs a version only for that one."""
        if self._reader and self._version is None:
            return "hstgrp"
        return "groups" if self.schema_version().startswith("3") else "hstgrp"

    def check_conn(self) -> bool:
        return self.table("hosts").limit(1).count() >= 0

    def _items(self) -> DataFrame:
        h = self.table("hosts").select("hostid", F.col("name").alias("host_name"))
        i = self.table("items").select("itemid", "hostid", "key_", F.col("name").alias("_name"), F.coalesce("units", F.lit("")).alias("units"))
        g = self.table("hosts_groups").select("hostid", "groupid").join(self.table(self._groups()).select("groupid", F.col("name").alias("group_name")), "groupid")
        return i.join(h, "hostid").join(g, "hostid")

    def get_item_ids(self, item_names=(), host_names=(), group_names=(), item_ids=(), max_items: int = 0) -> DataFrame:
        rows = self._items().where(name_matches(F.col("_name"), item_names) & name_matches(F.col("host_name"), host_names) & name_matches(F.col("group_name"), group_names))
        if item_ids:
            rows = rows.where(F.col("itemid").isin(list(item_ids)))
        ids = rows.select("itemid").distinct()
        return ids.orderBy("itemid").limit(max_items) if max_items else ids

    def get_item_details(self, ids: DataFrame | None = None) -> DataFrame:
        one = keep_latest(restrict(self._items(), ids), ["itemid"], F.col("group_name"))
        return one.select("group_name", "hostid", "host_name", "itemid", F.col("key_").alias("item_name"), "units", "key_")

    def _samples(self, name: str, startep: int, endep: int, ids: DataFrame | None) -> DataFrame:
        """Samples of a time range, read in parts by itemid: the ids in batches if they are few, or else even ranges."""
        if self._reader:
            return self.table(name)
        size = int(self.cfg.options.get("batch_size", 100))
        if ids is not None and len(few := [r.itemid for r in ids.select("itemid").distinct().limit(PUSHED_IDS + 1).collect()]) <= PUSHED_IDS:
            few.sort()
            batches = [f"itemid IN ({', '.join(map(str, few[k : k + size]))})" for k in range(0, len(few), size)]
        else:
            lo, hi = self.table("items").agg(F.min("itemid"), F.max("itemid")).first()
            n = int(self.cfg.options.get("partitions", 32))
            cuts = sorted({lo + (hi - lo) * k // n for k in range(1, n)}) if lo is not None else []
            edges = [None, *cuts, None]
            batches = [" AND ".join(x for x in (f"itemid >= {a}" if a is not None else "", f"itemid < {b}" if b is not None else "") if x) or "1 = 1" for a, b in zip(edges, edges[1:])]
        return self.table(name, [f"clock >= {startep} AND clock <= {endep} AND {x}" for x in batches] or ["1 = 0"])

    def _twins(self, name: str, values: list[str], startep: int, endep: int, ids: DataFrame | None) -> DataFrame:
        """The table for numbers and its twin for whole numbers."""
        cols = ["itemid", F.col("clock").cast("long").alias("clock"), *(F.col(v).cast("double").alias(v) for v in values)]
        both = self._samples(name, startep, endep, ids).select(*cols).unionByName(self._samples(f"{name}_uint", startep, endep, ids).select(*cols))
        return restrict(in_range(both, startep, endep), ids)

    def get_history(self, startep: int, endep: int, ids: DataFrame | None = None) -> DataFrame:
        return self._twins("history", ["value"], startep, endep, ids)

    def get_trends(self, startep: int, endep: int, ids: DataFrame | None = None) -> DataFrame:
        return self._twins("trends", ["value_min", "value_avg", "value_max"], startep, endep, ids)

    def get_events(self, startep: int, endep: int, host_names=()) -> DataFrame:
        """Problem events by host; an event of several items of a host counts once."""
        e = in_range(self.table("events").where("source = 0 and object = 0 and value = 1").select("eventid", F.col("clock").cast("long").alias("clock"), F.col("severity").cast("int").alias("severity"), "name", F.col("objectid").alias("triggerid")), startep, endep)
        t = self.table("triggers").select("triggerid")
        f = self.table("functions").select("triggerid", "itemid")
        i = self.table("items").select("itemid", "hostid")
        h = self.table("hosts").select("hostid", F.col("name").alias("host_name"))
        # the hosts of a trigger first: an event is joined with these, not with every item of them
        hosts = f.join(i, "itemid").join(h, "hostid").where(any_glob("host_name", host_names)).select("triggerid", "host_name").distinct()
        rows = e.join(t, "triggerid").join(hosts, "triggerid")
        return rows.select("eventid", "clock", "host_name", "severity", "name").distinct().drop("eventid")

    def item_link(self, api_url: str) -> Column:
        """The address of an item's chart over the last month."""
        return F.concat(F.lit(f"{api_url.rstrip('/')}/history.php?itemids%5B0%5D="), F.col("itemid").cast("string"), F.lit("&period=now-730h"))
