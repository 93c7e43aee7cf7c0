"""The samples of a monitoring database as a Spark data source, for batches and for streams.

    register(spark)
    spark.read.format("tidewatch").options(driver="psycopg2", dsn="...", table="history").load()
    spark.readStream.format("tidewatch").options(driver="psycopg2", dsn="...", settle="60").load()

Options: `driver` (a DB-API module), `dsn` (what its connect() takes), `table` (history or trends; each with its twin for
whole numbers), `itemRanges` (32), `batchRows` (50,000), `startep`, `endep` (both ends count), `settle` (seconds, 60).

A partition is a day of a range of items, so an item that holds most rows is split by days; a day of one item has at most
86,400 clocks. Filters on itemid and clock are sent to the database, and days and ranges that they leave out make no
partition. Rows reach Spark as Arrow batches; a task that is run again asks the same question again.

Without a lower end the oldest clock is asked for, which a database that keeps its samples by item has to look up in every
item; the upper end is the present.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from .. import schemas

SECONDS = 86400
TABLES = {"history": schemas.HISTORY, "trends": schemas.TRENDS}


@dataclass(frozen=True)
class Wanted:
    """Rows with low <= clock <= high and first <= itemid <= last; with `ids`, only of these items. None: no bound."""

    low: int | None = None
    high: int | None = None
    first: int | None = None
    last: int | None = None
    ids: frozenset[int] | None = None

    def both(self, other: Wanted) -> Wanted:
        top = lambda a, b: max(x for x in (a, b) if x is not None) if (a, b) != (None, None) else None
        low = lambda a, b: min(x for x in (a, b) if x is not None) if (a, b) != (None, None) else None
        ids = self.ids if other.ids is None else other.ids if self.ids is None else self.ids & other.ids
        return Wanted(top(self.low, other.low), low(self.high, other.high), top(self.first, other.first), low(self.last, other.last), ids)


def understood(f: Filter) -> Wanted | None:
    """What a filter asks for, if the database can answer it alone."""
    name = getattr(f, "attribute", None)
    if name not in (("clock",), ("itemid",)):
        return None
    clock = name == ("clock",)
    values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
    if any(type(v) is not int for v in values):
        return None
    at_least = lambda v: Wanted(low=v) if clock else Wanted(first=v)
    at_most = lambda v: Wanted(high=v) if clock else Wanted(last=v)
    # the exact classes: a filter that is refined by another class is not this one
    if type(f) is In:
        return None if clock else Wanted(ids=frozenset(values))
    if type(f) is EqualTo:
        return Wanted(low=f.value, high=f.value) if clock else Wanted(ids=frozenset(values))
    if type(f) is GreaterThan:
        return at_least(f.value + 1)
    if type(f) is GreaterThanOrEqual:
        return at_least(f.value)
    if type(f) is LessThan:
        return at_most(f.value - 1)
    if type(f) is LessThanOrEqual:
        return at_most(f.value)
    return None


@dataclass
class Part(InputPartition):
    """The rows of `wanted`, all bounds of which are set."""

    wanted: Wanted = field(default_factory=Wanted)


class _Database:
    def __init__(self, options: dict[str, str]):
        self.driver, self.dsn = options["driver"], options["dsn"]
        self.table = options.get("table", "history")
        if self.table not in TABLES:
            raise ValueError(f"unknown table {self.table!r}; one of {sorted(TABLES)}")
        self.names = TABLES[self.table].names
        self.ranges, self.rows = int(options.get("itemranges", 32)), int(options.get("batchrows", 50_000))
        number = lambda k: int(options[k]) if k in options else None
        self.limits = Wanted(low=number("startep"), high=number("endep"))

    def connect(self):
        return closing(importlib.import_module(self.driver).connect(self.dsn))

    def one(self, question: str) -> tuple:
        with self.connect() as c, closing(c.cursor()) as cur:
            cur.execute(question)
            return cur.fetchone()

    def items(self) -> tuple[int | None, int | None]:
        return self.one("SELECT min(itemid), max(itemid) FROM items")

    def oldest(self) -> int | None:
        found = [self.one(f"SELECT min(clock) FROM {t}")[0] for t in (self.table, f"{self.table}_uint")]
        return min((x for x in found if x is not None), default=None)

    def parts(self, wanted: Wanted) -> list[Part]:
        """Days by ranges of items, without those that hold nothing that is wanted."""
        first, last = self.items()
        if first is None:
            return []
        size = max(-(-(last - first + 1) // self.ranges), 1)
        spans = [Wanted(first=a, last=min(a + size - 1, last)) for a in range(first, last + 1, size)]
        low = self.oldest() if wanted.low is None else wanted.low
        high = int(time.time()) if wanted.high is None else wanted.high
        if low is None:
            return []
        out = []
        for span in spans:
            some = wanted.both(span)
            if some.ids is not None:
                some = replace(some, ids=frozenset(i for i in some.ids if some.first <= i <= some.last))
            if some.first > some.last or some.ids == frozenset():
                continue
            for day in range(low // SECONDS, high // SECONDS + 1):
                out.append(Part(wanted=replace(some, low=max(low, day * SECONDS), high=min(high, day * SECONDS + SECONDS - 1))))
        return out

    def read(self, w: Wanted) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([(f.name, {"bigint": pa.int64(), "double": pa.float64()}[f.dataType.simpleString()]) for f in TABLES[self.table].fields])
        within = f"clock >= {w.low} AND clock <= {w.high} AND itemid >= {w.first} AND itemid <= {w.last}"
        if w.ids is not None:
            within += f" AND itemid IN ({', '.join(map(str, sorted(w.ids)))})"
        with self.connect() as c:
            for name in (self.table, f"{self.table}_uint"):
                with closing(c.cursor()) as cur:
                    cur.execute(f"SELECT {', '.join(self.names)} FROM {name} WHERE {within}")
                    while rows := cur.fetchmany(self.rows):
                        cells = ([None if x is None else kind(x) for x in column] for column, kind in zip(zip(*rows), (int, int, float, float, float)))
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cells, schema)], schema=schema)


class _Reader(DataSourceReader):
    def __init__(self, db: _Database):
        self.db, self.wanted = db, db.limits

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            asked = understood(f)
            if asked is None:
                yield f
            else:
                self.wanted = self.wanted.both(asked)

    def partitions(self) -> list[Part]:
        # Spark takes no list without a partition for an empty table: one that asks for nothing stands for it
        return self.db.parts(self.wanted) or [Part(wanted=Wanted(0, -1, 0, -1))]

    def read(self, partition: Part) -> Iterator:
        return self.db.read(partition.wanted)


class _StreamReader(DataSourceStreamReader):
    """Offsets are clocks: a batch holds the rows from its start to before its end. The end stays `settle` seconds behind the
    present (or `endep`), so that samples stored late by no more than that are in it; later ones are not read."""

    def __init__(self, db: _Database, settle: int):
        self.db, self.settle = db, settle

    def _end(self) -> int:
        return (int(time.time()) if self.db.limits.high is None else self.db.limits.high + 1 + self.settle) - self.settle

    def initialOffset(self) -> dict:
        low = self.db.limits.low
        return {"clock": self._end() if low is None else low}

    def latestOffset(self) -> dict:
        return {"clock": self._end()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.db.parts(Wanted(low=start["clock"], high=end["clock"] - 1)) if start["clock"] < end["clock"] else []

    def read(self, partition: Part) -> Iterator:
        return self.db.read(partition.wanted)


class SampleSource(DataSource):
    """Rows of `tidewatch.schemas.HISTORY` or `TRENDS`."""

    @classmethod
    def name(cls) -> str:
        return "tidewatch"

    def schema(self) -> StructType:
        return TABLES[_Database(self.options).table]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Database(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(_Database(self.options), int(self.options.get("settle", 60)))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SampleSource)
