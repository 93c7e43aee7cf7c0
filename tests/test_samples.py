"""The samples of a database as a data source: pushed filters, partitions that are left out, streams."""

import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidewatch import config
from tidewatch.sources import samples
from tidewatch.streaming.fast import start_fast_axis

DAY = 86400


@pytest.fixture()
def db(tmp_path):
    path = str(tmp_path / "db.sqlite")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE items (itemid INTEGER)")
        c.executemany("INSERT INTO items VALUES (?)", [(i,) for i in range(1, 41)])
        for t in ("history", "history_uint"):
            c.execute(f"CREATE TABLE {t} (itemid INTEGER, clock INTEGER, value REAL)")
        for t in ("trends", "trends_uint"):
            c.execute(f"CREATE TABLE {t} (itemid INTEGER, clock INTEGER, value_min REAL, value_avg REAL, value_max REAL)")
        c.executemany("INSERT INTO history VALUES (?, ?, ?)", [(i, k * 3600, i + k / 4) for i in range(1, 31) for k in range(96)])
        c.executemany("INSERT INTO history_uint VALUES (?, ?, ?)", [(i, k * 3600, i) for i in range(31, 41) for k in range(96)])
        c.execute("INSERT INTO trends VALUES (1, 0, 1, 2, 3)")
        c.execute("INSERT INTO trends_uint VALUES (40, 3600, 4, NULL, 6)")
    return path


def load(spark, path, **more):
    samples.register(spark)
    return spark.read.format("tidewatch").options(driver="sqlite3", dsn=path, itemRanges=4, endep=4 * DAY - 1, **more).load()


def brute(path, where):
    with sqlite3.connect(path) as c:
        return sorted(c.execute(f"SELECT * FROM (SELECT * FROM history UNION ALL SELECT * FROM history_uint) WHERE {where}").fetchall())


@pytest.mark.parametrize("where, parts, pushed", [
    ("1 = 1", 16, True),
    ("clock >= 90000 AND clock < 172800", 4, True),
    ("clock > 172799 AND clock <= 180000 AND itemid = 35", 1, True),
    ("itemid IN (1, 2, 11, 99)", 8, True),
    ("itemid >= 31 AND itemid > 30 AND clock = 7200", 1, True),
    ("itemid < 11 AND itemid <= 10", 4, True),
    ("clock > 500000", 1, True),
    ("itemid % 7 = 3", 16, False),
    ("value > 38.5", 16, False),
    ("itemid = 3 OR clock = 7200", 16, False),
    ("clock IN (0, 3600)", 16, False),
])
def test_filters(spark, db, where, parts, pushed):
    df = load(spark, db).where(where)
    assert sorted(map(tuple, df.collect())) == brute(db, where)
    assert df.rdd.getNumPartitions() == parts
    plan = df._jdf.queryExecution().executedPlan().toString()
    left = re.findall(r"Filter (.*)", plan.replace("isnotnull", ""))  # what Spark itself still has to compare
    assert "BatchScan tidewatch" in plan and pushed == (not re.search(r"[<>=%]| IN ", " ".join(left)))


def test_trends_and_nulls(spark, db):
    assert sorted(map(tuple, load(spark, db, table="trends").collect())) == [(1, 0, 1.0, 2.0, 3.0), (40, 3600, 4.0, None, 6.0)]
    with pytest.raises(Exception, match="unknown table"):
        load(spark, db, table="hosts").collect()


def test_empty_database(spark, db):
    with sqlite3.connect(db) as c:
        c.execute("DELETE FROM history"), c.execute("DELETE FROM history_uint")
    assert load(spark, db).count() == 0
    with sqlite3.connect(db) as c:
        c.execute("DELETE FROM items")
    assert load(spark, db).count() == 0


def test_filters_that_are_not_asked():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, Not

    assert samples.understood(Not(EqualTo(("clock",), 1))) is None and samples.understood(IsNotNull(("clock",))) is None
    assert samples.understood(EqualTo(("value",), 1)) is None and samples.understood(GreaterThan(("clock",), 1.5)) is None
    assert samples.understood(EqualTo(("itemid",), True)) is None and samples.understood(In(("clock",), (1, 2))) is None
    assert samples.understood(In(("itemid",), (1, None))) is None


def stream(spark, path, end, **more):
    samples.register(spark)
    return spark.readStream.format("tidewatch").options(driver="sqlite3", dsn=path, itemRanges=4, startep=DAY, endep=end, settle=0, **more).load()


def test_stream_goes_on_where_it_stopped(spark, db, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for end in (2 * DAY, 2 * DAY, 3 * DAY):
        stream(spark, db, end).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination(120)
        got = spark.read.parquet(out)
        assert sorted(map(tuple, got.collect())) == brute(db, f"clock BETWEEN {DAY} AND {end}")


def test_stream_feeds_the_fast_axis(spark, db, tmp_path):
    seen = []
    items = spark.createDataFrame([(f"g{i % 2}", 1, "h", i, f"n{i}", "", f"k{i}") for i in range(1, 41)], "group_name string, hostid long, host_name string, itemid long, item_name string, units string, key_ string")
    start_fast_axis(
        stream(spark, db, 3 * DAY), lambda a, b: load(spark, db).where(F.col("clock").between(a, b)), items, None, config.Source(),
        lambda events, end: seen.append((end, events.count())), str(tmp_path / "mark"),
    ).awaitTermination(240)
    assert [e for e, _ in seen] == [3 * DAY]
