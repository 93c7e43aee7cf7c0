"""Every query against DuckDB on the smallest tables."""

import math
import os

import pytest

from tidewatch.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def tidy(v):
    return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(tidy(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


def twice(spark, name):
    """The rows of a query without SQL, the same on a second run."""
    first, again = (catalogue.QUERIES[name](spark, SF).collect() for _ in range(2))
    assert first and sorted(map(repr, first)) == sorted(map(repr, again))
    return first


def test_hourly_detection(spark):
    """Each item once, only those that a detector scores, in a cluster only if it is an anomaly."""
    found = twice(spark, "hourly_detection")
    ids = {r.itemid for r in found}
    scored = {r.itemid for q in ("zscore_scores", "seasonal_scores", "changepoint_scores") for r in catalogue.QUERIES[q](spark, SF).collect()}
    assert len(ids) == len(found) and ids <= scored
    assert all(0 <= r.score <= 1 and 0 <= r.raw_score <= 1 for r in found)
    assert all(r.is_anomaly for r in found if r.clusterid >= 0) and {r.is_anomaly for r in found} == {True, False}


def test_fast_detection(spark):
    """Events of known hosts, whose scores are probabilities."""
    found = twice(spark, "fast_detection")
    items = catalogue.b.items(spark, SF)
    hosts = {r.host_name for r in items.select("host_name").collect()}
    assert all(0 < r.score <= 1 and r.n_items >= 1 and r.reason for r in found)
    assert {r.host for r in found if r.host} <= hosts and sum(r.n_items for r in found) <= items.count() * len(found)


def test_every_query_has_sql_or_a_test():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"hourly_detection", "fast_detection"}
