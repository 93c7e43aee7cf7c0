"""Sinks: Parquet tables with upsert by key, one folder per data source, and exports.

A table is a folder of versions; a write makes a new version and then moves the pointer, so readers never see half a
table and a failed write changes nothing. The previous version stays until the next write for those who still read it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.scalar import finite
from ..functions.sequence import keep_latest
from ..operators import panes
from ..scratch import materialize, scope


class Table:
    """A keyed table at `path` (any file system that Spark can write)."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        #: Called before a write begins and before it shows; raises if this run may not write (any more).
        self.guard: Callable[[], None] = lambda: None

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def create(self) -> None:
        """An empty table, unless it exists."""
        if not self.versions():
            self.replace(self.spark.createDataFrame([], self.schema))

    def drop(self) -> None:
        self.guard()
        fs, path = self._fs()
        fs.delete(path(self.path), True)

    def truncate(self) -> None:
        self.replace(self.spark.createDataFrame([], self.schema))

    def read(self) -> DataFrame:
        """All rows; columns that an older version lacks are null."""
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{have[-1]}")

    def replace(self, df: DataFrame) -> None:
        self.guard()
        have = self.versions()
        fs, path = self._fs()
        made, final = path(f"{self.path}/w-{uuid.uuid4().hex}"), path(f"{self.path}/v{(have[-1] if have else 0) + 1}")
        try:
            self._cast(df).write.parquet(made.toString())
            self.guard()
            fs.delete(final, True)  # of a write that was cut off
            if not fs.rename(made, final):
                raise OSError(f"can't move {made} to {final}")
        finally:
            fs.delete(made, True)
        for v in have[:-1]:
            fs.delete(path(f"{self.path}/v{v}"), True)

    def _cast(self, df: DataFrame) -> DataFrame:
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields))

    def upsert(self, df: DataFrame) -> None:
        """Rows of `df` take the place of those with their key; of several with one key, any one."""
        new = keep_latest(self._cast(df), self.keys, *(F.col(k) for k in self.keys))
        old = self.read().join(new.select(*self.keys), self.keys, "left_anti").select(*self.schema.names)
        self.replace(old.unionByName(new))

    def delete_ids(self, ids: DataFrame) -> None:
        self.replace(self.read().join(ids.select("itemid").distinct(), "itemid", "left_anti").select(*self.schema.names))

    def delete_before(self, column: str, cutoff: int) -> None:
        self.replace(self.read().where(F.col(column) >= cutoff))

    def split_existing(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The ids that have rows, and those that have none."""
        have = self.read().select("itemid").distinct()
        return ids.join(have, "itemid", "left_semi"), ids.join(have, "itemid", "left_anti")


class DayTable(Table):
    """A keyed table in parts, by the day of the key `clock`: a write makes only those days anew that it touches."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], clock: str):
        super().__init__(spark, path, schema, keys)
        self.clock = clock

    def days(self) -> dict[int, Table]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return {int(n[1:]): self._part(int(n[1:])) for n in names if n.startswith("d") and n[1:].lstrip("-").isdigit()}

    def _part(self, day: int) -> Table:
        part = Table(self.spark, f"{self.path}/d{day}", self.schema, self.keys)
        part.guard = self.guard
        return part

    def _day(self):
        return F.floor(F.col(self.clock) / 86400).cast("long")

    def create(self) -> None:
        fs, path = self._fs()
        fs.mkdirs(path(self.path))

    def read(self) -> DataFrame:
        parts = [f"{t.path}/v{v[-1]}" for _, t in sorted(self.days().items()) if (v := t.versions())]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def read_days(self, days: set[int]) -> DataFrame:
        """The rows of some days alone."""
        parts = [f"{t.path}/v{v[-1]}" for d, t in sorted(self.days().items()) if d in days and (v := t.versions())]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def _each_day(self, df: DataFrame, write) -> set[int]:
        with scope():
            rows = materialize(self._cast(df), "store-rows")
            found = {r[0] for r in rows.select(self._day()).distinct().collect()}  # a row for each day
            for day in sorted(found):
                write(self._part(day), rows.where(self._day() == day))
        return found

    def replace(self, df: DataFrame) -> None:
        have = self.days()
        new = self._each_day(df, lambda t, rows: t.replace(rows))
        for day in set(have) - new:
            have[day].drop()

    def upsert(self, df: DataFrame) -> set[int]:
        """The days that were made anew."""
        return self._each_day(df, lambda t, rows: t.upsert(rows))

    def delete_ids(self, ids: DataFrame) -> None:
        for t in self.days().values():
            t.delete_ids(ids)

    def delete_before(self, column: str, cutoff: int) -> None:
        for day, t in self.days().items():
            if column == self.clock and (day + 1) * 86400 <= cutoff:
                t.drop()
            elif column != self.clock or day * 86400 < cutoff:
                t.delete_before(column, cutoff)


class Paned:
    """Trends by days, and the partial statistics of their hours: what arrives, early or late, marks its hours, and only those are
    made anew. A call that failed can be repeated: rows and panes have keys."""

    VALUES = ("value_avg", "value_min", "value_max")

    def __init__(self, rows: DayTable, hours: DayTable):
        self.rows, self.hours = rows, hours

    def add(self, arrivals: DataFrame) -> None:
        with scope():
            new = materialize(arrivals, "pane-arrivals")
            days = self.rows.upsert(new)
            pane = panes.pane_of(F.col("clock")).alias("pane")
            dirty = materialize(new.select("itemid", pane).distinct(), "pane-dirty")
            rows = self.rows.read_days(days).withColumn("pane", pane).join(dirty, ["itemid", "pane"], "left_semi")
            self.hours.upsert(panes.partials(rows, *self.VALUES))

    def within(self, startep: int, endep: int) -> DataFrame:
        """The panes of a window."""
        ends = {startep // 86400, endep // 86400}
        return panes.within(self.hours.read(), self.rows.read_days(ends), startep, endep, *self.VALUES)

    def delete_before(self, cutoff: int) -> None:
        self.rows.delete_before("clock", cutoff)
        self.hours.delete_before("pane", cutoff - panes.PANE + 1)


class Stores:
    """All tables of one data source."""

    def __init__(self, spark: SparkSession, root: str, ds_name: str):
        at = lambda name: f"{root.rstrip('/')}/{ds_name}/{name}"
        self.spark = spark
        self.history = DayTable(spark, at("history"), schemas.HISTORY, ["itemid", "clock"], "clock")
        self.history_stats = Table(spark, at("history_stats"), schemas.STATS, ["itemid"])
        self.trends = DayTable(spark, at("trends"), schemas.TRENDS, ["itemid", "clock"], "clock")
        self.trend_panes = DayTable(spark, at("trend_panes"), schemas.PANES, ["itemid", "pane"], "pane")
        self.trends_stats = Table(spark, at("trends_stats"), schemas.STATS, ["itemid"])
        self.hour_stats = Table(spark, at("hour_stats"), schemas.HOUR_STATS, ["itemid", "hour_of_day"])
        self.anomalies = DayTable(spark, at("anomalies"), schemas.ANOMALIES, ["itemid", "created", "group_name"], "created")
        self.history_updates = Table(spark, at("history_updates"), schemas.UPDATES, [])
        self.trends_updates = Table(spark, at("trends_updates"), schemas.UPDATES, [])

    def all(self) -> list[Table]:
        return [t for t in vars(self).values() if isinstance(t, Table)]

    def guarded(self, guard: Callable[[], None]) -> Stores:
        """These tables, written only while `guard` doesn't raise."""
        for t in self.all():
            t.guard = guard
        return self

    def create(self) -> None:
        for t in self.all():
            t.create()

    def init(self) -> None:
        """Drops and recreates every table."""
        for t in self.all():
            t.drop()
            t.create()

    def read_history(self, ids: DataFrame | None = None, startep: int = 0, endep: int = 0) -> DataFrame:
        """Cached samples; a bound of 0 is none."""
        df = self.history.read()
        df = df.where(F.col("clock") >= startep) if startep else df
        df = df.where(F.col("clock") <= endep) if endep else df
        return df if ids is None else df.join(ids.select("itemid").distinct(), "itemid", "left_semi")

    def read_hours(self, hour: int | None = None) -> DataFrame:
        df = self.hour_stats.read()
        return df if hour is None else df.where(F.col("hour_of_day") == hour)

    def get_watermark(self, table: Table) -> tuple[int, int]:
        row = table.read().first()
        return (row.startep, row.endep) if row else (0, 0)

    def set_watermark(self, table: Table, startep: int, endep: int) -> None:
        table.replace(self.spark.createDataFrame([(startep, endep)], schemas.UPDATES))

    @staticmethod
    def _clean(df: DataFrame) -> DataFrame:
        cut = lambda c: F.substring(c, 1, 255)
        known = lambda c: F.coalesce(finite(F.col(c)), F.lit(0.0))
        return df.withColumns({"item_name": cut(F.regexp_replace("item_name", "'", "")), "host_name": cut(F.col("host_name")), "group_name": cut(F.col("group_name")), "trend_mean": known("trend_mean"), "trend_std": known("trend_std")})

    def insert_anomalies(self, df: DataFrame) -> None:
        """Strings are cut to 255, quotes go from item names, unknown means are 0, a new row is in no cluster."""
        old = self.anomalies.read().select("itemid", "created", "group_name", F.col("clusterid").alias("_old"))
        rows = self._clean(df.drop("clusterid"))
        rows = rows.join(old, ["itemid", "created", "group_name"], "left").withColumn("clusterid", F.coalesce("_old", F.lit(-1)))
        self.anomalies.upsert(rows)

    def record_cycle(self, rows: DataFrame, clusters: DataFrame, created: int, keep_from: int) -> None:
        """insert_anomalies(), update_clusters() of the cycle and the removal of old rows, in one write of the days concerned."""
        fresh = self._clean(rows.drop("clusterid")).join(clusters.select("itemid", "clusterid"), "itemid", "left").withColumn("clusterid", F.coalesce("clusterid", F.lit(-1)))
        self.anomalies.upsert(fresh)
        self.anomalies.delete_before("created", keep_from)

    def update_clusters(self, clusters: DataFrame, created: int | None = None) -> None:
        """Clusters of one cycle (or of all rows): rows without one get -1."""
        rows = self.anomalies.read()
        rows = rows if created is None else rows.where(F.col("created") == created)
        j = rows.drop("clusterid").join(clusters.select("itemid", "clusterid"), "itemid", "left")
        self.anomalies.upsert(j.withColumn("clusterid", F.coalesce("clusterid", F.lit(-1))))

    def recorded_ids(self, since: int = 0) -> DataFrame:
        rows = self.anomalies.read()
        return (rows.where(F.col("created") >= since) if since else rows).select("itemid").distinct()

    def read_anomalies(self, since: int = 0) -> DataFrame:
        rows = self.anomalies.read()
        return (rows.where(F.col("created") >= since) if since else rows).orderBy(F.col("created").desc(), F.col("score").desc())


def write_csv(df: DataFrame, path: str) -> None:
    """One gzipped CSV file at `path`, by way of a folder beside it: for exports that people take away."""
    spark = df.sparkSession
    out = f"{path}.parts"
    df.coalesce(1).write.mode("overwrite").option("header", True).option("compression", "gzip" if path.endswith(".gz") else "none").option("escape", '"').csv(out)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(out).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(hadoop(out)) if s.getPath().getName().startswith("part-"))
    fs.delete(hadoop(path), False)
    fs.rename(part, hadoop(path))
    fs.delete(hadoop(out), True)


def write_text_atomic(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the file and renames, so that readers see the old or the new text."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    tmp = hadoop(f"{path}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), spark._jsc.hadoopConfiguration())
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context.rename(tmp.makeQualified(fs.getUri(), fs.getWorkingDirectory()), hadoop(path).makeQualified(fs.getUri(), fs.getWorkingDirectory()), options)


def event_path(path: str, ds_name: str, n_sources: int) -> str:
    """With several sources, each has its own file: stem.source.suffix."""
    if n_sources <= 1:
        return path
    stem, dot, suffix = path.rpartition(".")
    return f"{stem}.{ds_name}.{suffix}" if dot and "/" not in suffix else f"{path}.{ds_name}"


def write_event_file(result: DataFrame, path: str) -> dict:
    """The event document of build_result(), one row, as JSON; only events of a host alone have its name."""
    row = result.select(F.to_json(F.struct(*result.columns), {"ignoreNullFields": "false"}).alias("j")).first().j
    document = json.loads(row)
    for event in document["events"]:
        if event.get("host", "") is None:
            del event["host"]
    write_text_atomic(result.sparkSession, path, json.dumps(document, indent=2))
    return document


def export_dataset(source, ids: DataFrame | None, history_start: int, trends_start: int, endep: int, folder: str, cycles: list[int] = ()) -> None:
    """A data set folder that the CSV source reads."""
    spark = (ids if ids is not None else source.get_item_ids()).sparkSession
    write_csv(source.get_history(history_start, endep, ids).orderBy("itemid", "clock"), f"{folder}/history.csv.gz")
    write_csv(source.get_trends(trends_start, endep, ids).orderBy("itemid", "clock"), f"{folder}/trends.csv.gz")
    write_csv(source.get_item_details(ids).select("group_name", "hostid", "host_name", "itemid", F.col("key_").alias("item_name"), "units").orderBy("itemid"), f"{folder}/items.csv.gz")
    write_csv(source.get_events(history_start, endep).orderBy("clock"), f"{folder}/events.csv.gz")
    write_text_atomic(spark, f"{folder}/endep.txt", f"{endep}\n")
    if cycles:
        write_text_atomic(spark, f"{folder}/cycles.txt", "".join(f"{c}\n" for c in cycles))


def export_anomalies(anomalies: DataFrame, folder: str, latest_only: bool = True) -> None:
    """anomalies.csv: the newest cycle or all, best score of each item, highest first."""
    rows = anomalies.join(anomalies.agg(F.max("created").alias("created")), "created", "left_semi") if latest_only else anomalies
    best = keep_latest(rows, ["itemid"], F.col("score").desc(), F.col("created").desc(), F.col("group_name"))
    write_csv(best.withColumn("detector_scores", F.to_json("detector_scores")).orderBy(F.col("score").desc(), "itemid"), f"{folder}/anomalies.csv")


def export_labels(selected: DataFrame, folder: str) -> None:
    """scores.csv with bands, and labels.csv with the proposed labels."""
    from ..operators.filters import score_band

    rows = selected.select(F.col("itemid").alias("item_id"), F.round("score", 4).alias("score"), score_band(F.col("score")).alias("band"), score_band(F.col("score"), True).alias("pre_label"))
    write_csv(rows.orderBy(F.col("score").desc(), "item_id"), f"{folder}/scores.csv")
    write_csv(rows.select("item_id", F.col("pre_label").alias("label"), F.col("band").alias("note")).orderBy("item_id"), f"{folder}/labels.csv")


def write_skeleton_labels(ids: DataFrame, path: str) -> bool:
    """Labels of -1 for all items; an existing file is left alone."""
    spark = ids.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    if hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(path)):
        return False
    write_csv(ids.select(F.col("itemid").alias("item_id"), F.lit(-1).alias("label"), F.lit("").alias("note")).orderBy("item_id"), path)
    return True
