"""Exact quantiles by rounds of histograms."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.selection import exact_quantile


def got(df, *keys):
    return sorted(((*(r[k] for k in keys), r["quantile"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_equals_percentile(spark, q):
    """Even and odd counts, ties, one value with most of the weight, values of all magnitudes, null keys and values."""
    x = F.when(F.col("id") % 7 == 0, F.lit(3.0)).when(F.col("id") % 7 == 1, F.pow(F.lit(2.0), F.pmod(F.hash("id"), F.lit(600)))).otherwise(F.pmod(F.hash("id"), F.lit(20000)) / 4 - 1000)
    key = F.when(F.col("id") % 10 < 5, "hot").when(F.col("id") % 10 < 7, F.lit(None)).when(F.col("id") < 3000, "small").when(F.col("id") % 10 == 7, "odd").otherwise("none")
    df = spark.range(20001).select(key.alias("k"), F.when(F.coalesce(key != "none", F.lit(True)), x).alias("v"))
    want = df.where("v is not null").groupBy("k").agg(F.percentile("v", q).alias("quantile"))
    for at_most in (20, 400, 10_000):
        assert got(exact_quantile(df, ["k"], "v", q, at_most), "k") == got(want, "k")


def test_whole_table_and_empty_ones(spark):
    df = spark.range(1000).select(F.col("id").alias("v"), F.lit(None).cast("string").alias("k"))
    assert got(exact_quantile(df, [], "v", 0.5, 10)) == [(499.5,)]
    assert got(exact_quantile(df.limit(0), [], "v")) == [] and got(exact_quantile(df.select(F.lit(1).alias("k"), F.lit(None).cast("double").alias("v")), ["k"], "v"), "k") == []
    with pytest.raises(ValueError):
        exact_quantile(df, [], "v", 1.5)
    assert got(exact_quantile(df.withColumn("v", F.col("v") % 3), [], "v", 0.5, 2)) == [(1.0,)]
    with pytest.raises(ValueError):
        exact_quantile(df, [], "v", 0.5, 1)


def test_clashing_names_and_two_keys(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("quantile_"), (F.col("id") % 3).alias("_n"), F.col("id").alias("_x"))
    want = df.groupBy("quantile_", "_n").agg(F.percentile("_x", 0.5).alias("quantile"))
    assert got(exact_quantile(df, ["quantile_", "_n"], "_x", 0.5, 50), "quantile_", "_n") == got(want, "quantile_", "_n")


def test_most_gaps_of_one_item(spark):
    """Two million distinct values of one key: no task of the last round holds more than `at_most` of them."""
    df = spark.range(2_000_000).select(F.lit(1).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(2**40)) / 8).alias("v"))
    assert got(exact_quantile(df, ["k"], "v", 0.5, 5000), "k") == got(df.groupBy("k").agg(F.percentile("v", 0.5).alias("quantile")), "k")
