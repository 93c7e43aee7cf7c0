"""Sources: where history, trends, items and problem events come from."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..config import Source


class DataSource(Protocol):
    """What every source offers; all frames have the columns of `tidewatch.schemas`."""

    def check_conn(self) -> bool: ...

    def get_item_ids(self, item_names=(), host_names=(), group_names=(), item_ids=(), max_items: int = 0) -> DataFrame: ...

    def get_item_details(self, ids: DataFrame | None = None) -> DataFrame: ...

    def get_history(self, startep: int, endep: int, ids: DataFrame | None = None) -> DataFrame: ...

    def get_trends(self, startep: int, endep: int, ids: DataFrame | None = None) -> DataFrame: ...

    def get_events(self, startep: int, endep: int, host_names=()) -> DataFrame: ...


def get_data_source(spark: SparkSession, cfg: Source) -> DataSource:
    """The source of a configuration: csv, parquet or jdbc."""
    from .files import CsvSource, ParquetSource
    from .jdbc import JdbcSource

    kinds = {"csv": CsvSource, "parquet": ParquetSource, "jdbc": JdbcSource}
    if cfg.type not in kinds:
        raise ValueError(f"unknown source type {cfg.type!r}; one of {sorted(kinds)}")
    return kinds[cfg.type](spark, cfg)
