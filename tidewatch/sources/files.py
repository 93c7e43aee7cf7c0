"""Data sets in a folder: gzipped CSV as exported, or Parquet tables of the same names."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Source
from ..functions.scalar import matches_glob
from ..functions.sequence import keep_latest
from ..operators.stats import in_range


def restrict(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    return df if ids is None else df.join(ids.select("itemid").distinct(), "itemid", "left_semi")


def any_glob(column: str, patterns) -> F.Column:
    return reduce(lambda a, b: a | b, [matches_glob(F.col(column), p) for p in patterns], F.lit(not patterns))


class _Folder:
    def __init__(self, spark: SparkSession, cfg: Source):
        self.spark, self.cfg, self.dir = spark, cfg, cfg.data_dir.rstrip("/")

    def _history(self) -> DataFrame:
        raise NotImplementedError

    def _trends(self) -> DataFrame:
        raise NotImplementedError

    def _items(self) -> DataFrame:
        raise NotImplementedError

    def _events(self) -> DataFrame:
        raise NotImplementedError

    def check_conn(self) -> bool:
        try:
            self._history().limit(1).count()
            return True
        except AnalysisException:
            return False

    def get_item_ids(self, item_names=(), host_names=(), group_names=(), item_ids=(), max_items: int = 0) -> DataFrame:
        """Distinct ids of the history, those that appear first in its files first; a folder has no use for name filters."""
        ids = self._history().select("itemid", F.monotonically_increasing_id().alias("at")).groupBy("itemid").agg(F.min("at").alias("at"))
        if item_ids:
            ids = ids.where(F.col("itemid").isin(list(item_ids)))
        return (ids.orderBy("at").limit(max_items) if max_items else ids).select("itemid")

    def get_item_details(self, ids: DataFrame | None = None) -> DataFrame:
        """One row an item: that of the lowest group name, if it is in several."""
        return keep_latest(restrict(self._items(), ids), ["itemid"], F.col("group_name"), F.col("hostid"))

    def get_history(self, startep: int, endep: int, ids: DataFrame | None = None) -> DataFrame:
        return restrict(in_range(self._history(), startep, endep), ids)

    def get_trends(self, startep: int, endep: int, ids: DataFrame | None = None) -> DataFrame:
        return restrict(in_range(self._trends(), startep, endep), ids)

    def get_events(self, startep: int, endep: int, host_names=()) -> DataFrame:
        try:
            events = self._events()
        except AnalysisException:  # the table is optional
            return self.spark.createDataFrame([], schemas.EVENTS)
        return in_range(events, startep, endep).where(any_glob("host_name", host_names))


class CsvSource(_Folder):
    """history.csv.gz, trends.csv.gz, items.csv.gz and, if there, events.csv.gz."""

    def _strings(self, name: str, columns: list[str]) -> DataFrame:
        """Columns by position, whatever the header calls them; rows that repeat the header go."""
        raw = self.spark.read.schema(", ".join(f"{c} string" for c in columns)).option("header", True).option("enforceSchema", True).csv(f"{self.dir}/{name}.csv.gz")
        return raw.where(F.coalesce(F.col("clock") != "clock", F.lit(True))) if "clock" in columns else raw

    def _history(self) -> DataFrame:
        rows = self._strings("history", ["itemid", "clock", "value"])
        # a clock that is no number drops the row; a value that is none is an error
        return rows.select(F.col("itemid").cast("long").alias("itemid"), F.expr("cast(try_cast(clock as double) as long)").alias("clock"), F.col("value").cast("double").alias("value")).where("clock is not null")

    def _trends(self) -> DataFrame:
        rows = self._strings("trends", ["itemid", "clock", "value_min", "value_avg", "value_max"])
        value = [F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(0.0)).alias(c) for c in ("value_min", "value_avg", "value_max")]
        return rows.select(F.col("itemid").cast("long").alias("itemid"), F.expr("cast(try_cast(clock as double) as long)").alias("clock"), *value).where("clock is not null")

    def _items(self) -> DataFrame:
        raw = self.spark.read.option("header", True).csv(f"{self.dir}/items.csv.gz")
        for c in ("group_name", "host_name", "item_name", "units"):
            raw = raw.withColumn(c, F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit(""))
        return raw.select("group_name", F.col("hostid").cast("long").alias("hostid"), "host_name", F.col("itemid").cast("long").alias("itemid"), "item_name", "units", F.col("item_name").alias("key_"))

    def _events(self) -> DataFrame:
        rows = self._strings("events", ["clock", "host_name", "severity", "name"])
        return rows.select(F.expr("cast(try_cast(clock as double) as long)").alias("clock"), "host_name", F.coalesce(F.expr("try_cast(severity as int)"), F.lit(0)).alias("severity"), "name").where("clock is not null")


class ParquetSource(_Folder):
    """The same tables as Parquet: filters on time and item reach the files."""

    def _read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.dir}/{name}")

    def _history(self) -> DataFrame:
        return self._read("history", schemas.HISTORY)

    def _trends(self) -> DataFrame:
        return self._read("trends", schemas.TRENDS)

    def _items(self) -> DataFrame:
        return self._read("items", schemas.ITEMS)

    def _events(self) -> DataFrame:
        return self._read("events", schemas.EVENTS)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a CSV file; a missing incident is '', a missing confidence 1."""
    raw = spark.read.option("header", True).csv(path)
    for c in ("note", "incident", "confidence"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    return raw.select(
        F.col("item_id").cast("long").alias("item_id"), F.expr("try_cast(label as int)").alias("label"), F.coalesce("note", F.lit("")).alias("note"),
        F.coalesce("incident", F.lit("")).alias("incident"), F.coalesce(F.expr("try_cast(confidence as double)"), F.lit(1.0)).alias("confidence"),
    )


def discover_datasets(spark: SparkSession, root: str) -> list[str]:
    """Folders under `root` that hold a labels.csv, sorted."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "labels.csv").format("binaryFile").load(root).select("path").collect()
    return sorted(r.path.rsplit("/", 1)[0] for r in files)


def read_epochs(spark: SparkSession, path: str) -> list[int]:
    """The epochs of endep.txt or cycles.txt, one a line."""
    return [int(r.value) for r in spark.read.text(path).where("trim(value) <> ''").collect()]


def read_anomalies(spark: SparkSession, folder: str, endep: int) -> DataFrame:
    """anomalies.csv.gz, else anomalies.csv; a missing `created` is the data set's end."""
    try:
        raw = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/anomalies.csv.gz")
    except AnalysisException:
        raw = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/anomalies.csv")
    if "created" not in raw.columns:
        raw = raw.withColumn("created", F.lit(endep).cast("string"))
    num = lambda c, t: F.expr(f"try_cast({c} as {t})").alias(c)
    return raw.select(
        num("itemid", "long"), num("created", "long"), "group_name", num("hostid", "long"), F.coalesce(num("clusterid", "int"), F.lit(-1)).alias("clusterid"), "host_name", "item_name",
        num("trend_mean", "double"), num("trend_std", "double"), num("score", "double"), F.from_json("detector_scores", "map<string,double>").alias("detector_scores"), F.coalesce(num("rescued", "boolean"), F.lit(False)).alias("rescued"),
    )
