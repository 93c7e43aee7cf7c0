"""Exact quantiles of groups of any size, without a group's values in one place.

Equal values are counted first. A group with few distinct values is finished by Spark's percentile with frequencies; a
larger one is narrowed in rounds: splitters from a sketch of its distinct values, a histogram of the weights between them,
and only the values between the splitters around the wanted rank go on. A round divides them by about `SPLITTERS`, whatever
their distribution. Rows of a large group are dealt by value, never by the group alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import kept, materialize, scope

#: Splitters of a round; their sketch's error is a fraction 1 / ACCURACY of a group's distinct values.
SPLITTERS = 31
ACCURACY = 1000
#: Parts that the rows of a large group are dealt to where they meet the group's row.
SALTS = 64


def _meet(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on the keys, the few rows of `groups` repeated for each part of a group's rows."""
    dealt = rows.withColumn("_salt", F.pmod(F.hash("_x"), F.lit(SALTS)))
    return dealt.join(groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"]).drop("_salt")


def _at(rank: str) -> Column:
    """The value that holds a rank, from rows with the weight up to and with them."""
    return F.min(F.when(F.col("_upto") > F.col(rank), F.col("_x")))


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float = 0.5, at_most: int = 10_000) -> DataFrame:
    """(keys, quantile): the value at rank q * (n - 1) of each group's values that aren't null, between two ranks by their
    distance, as percentile() has it; groups without a value have no row. `at_most` distinct values of a group are
    handled in one task. No keys: one row, or none without a value.

    Defined cases: null keys are a group of their own; NaN is the highest value; ties count as often as they occur.
    """
    if not 0 <= q <= 1 or at_most < 2:  # a quantile may lie between two values
        raise ValueError("q is between 0 and 1, at_most 2 or more")
    names = [f"_k{i}" for i in range(len(keys))] + ["_one"]
    by = [F.struct(F.col(k)).alias(n) for k, n in zip(keys, names)]  # a struct of a null is none, so null keys meet
    back = [F.col(n)[k].alias(k) for k, n in zip(keys, names)]
    with scope():
        x = df.select(*by, F.lit(1).alias("_one"), F.col(value).cast("double").alias("_x")).where("_x is not null")
        rows = materialize(x.groupBy(*names, "_x").agg(F.count(F.lit(1)).alias("_n")), "weights")
        size = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_d"), F.sum("_n").alias("_all"))
        pos = F.lit(float(q)) * (F.col("_all") - 1)
        size = materialize(size.select(*names, "_d", pos.alias("_pos"), F.floor(pos).alias("_lo"), F.ceil(pos).alias("_hi"), F.lit(0).cast("long").alias("_before")), "group-sizes")
        large = size.where(F.col("_d") > at_most)
        found = []
        if large.isEmpty():
            found.append(_finish_small(rows, names, q))
        else:
            found.append(_finish_small(_meet(rows, size.where(F.col("_d") <= at_most).select(*names), names), names, q))
            rows, groups = materialize(_meet(rows, large.select(*names), names), "candidates"), large
            while not groups.isEmpty():
                rows, groups = _narrow(rows, groups, names)
                done = groups.where(F.col("_d") <= at_most)
                found.append(materialize(_finish(_meet(rows, done.drop("_d"), names), names), "quantiles"))
                groups = materialize(groups.where(F.col("_d") > at_most), "groups")
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return kept(out.select(*back, "quantile"), "exact-quantiles")


def _finish_small(rows: DataFrame, names: list[str], q: float) -> DataFrame:
    return rows.groupBy(*names).agg(F.percentile("_x", q, F.col("_n")).alias("quantile"))


def _narrow(rows: DataFrame, groups: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The values of the histogram's bins that hold the wanted ranks, and the groups with the weight below these bins."""
    marks = rows.groupBy(*names).agg(F.percentile_approx("_x", [(i + 1) / (SPLITTERS + 1) for i in range(SPLITTERS)], ACCURACY).alias("_marks"))
    bins = F.size(F.filter("_marks", lambda m: m < F.col("_x")))
    dealt = materialize(_meet(rows, marks, names).select(*names, "_x", "_n", bins.alias("_bin")), "bins")
    counts = dealt.groupBy(*names, "_bin").agg(F.sum("_n").alias("_w"), F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_w").over(Window.partitionBy(*names).orderBy("_bin"))  # at most SPLITTERS + 1 rows a group
    placed = groups.drop("_d").join(counts, names).withColumn("_upto", upto + F.col("_before")).withColumn("_from", F.col("_upto") - F.col("_w"))
    hit = placed.where((F.col("_upto") > F.col("_lo")) & (F.col("_from") <= F.col("_hi")))
    after = materialize(
        hit.groupBy(*names, "_pos", "_lo", "_hi").agg(F.sum("_c").alias("_d"), F.min("_from").alias("_before"), F.min("_bin").alias("_first"), F.max("_bin").alias("_last")), "narrowed",
    )
    left = _meet(dealt, after.select(*names, "_first", "_last"), names).where(F.col("_bin").between(F.col("_first"), F.col("_last")))
    return materialize(left.select(*names, "_x", "_n"), "candidates"), after.drop("_first", "_last")


def _finish(rows: DataFrame, names: list[str]) -> DataFrame:
    """Groups of few rows, each row with its group's ranks."""
    w = Window.partitionBy(*names).orderBy("_x")
    at = rows.withColumn("_upto", F.sum("_n").over(w) + F.col("_before")).groupBy(*names, "_pos", "_lo", "_hi").agg(_at("_lo").alias("a"), _at("_hi").alias("b"))
    between = (F.col("_hi") - F.col("_pos")) * F.col("a") + (F.col("_pos") - F.col("_lo")) * F.col("b")
    return at.select(*names, F.when((F.col("_lo") == F.col("_hi")) | F.col("a").eqNullSafe(F.col("b")), F.col("a")).otherwise(between).alias("quantile"))
