"""Thousands of glob rules as a table: keys meet only the rules whose literal text they hold.

A glob starts with literal text, its head, or, if it starts with a wildcard, holds some further on. Keys are exploded to
their prefixes of the lengths that heads have and, for the others, to their runs of GRAM characters; an equi-join on these
proposes rules, the glob itself decides, and the lowest number wins. Rules without so much literal text meet every key.
"""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
_WILD = re.compile(r"\[[!^]?\]?[^\]]*\]|[*?\[]")


def rule_table(spark: SparkSession, globs: list[tuple[int, str]]) -> DataFrame:
    """(rule, regex, kind, text) of numbered globs; kind says where a key has to hold the text: head, gram or none."""
    rows = []
    for number, glob in globs:
        runs = _WILD.split(glob)
        head, longest = runs[0], max(runs, key=len)
        kind, text = ("head", head) if len(head) >= GRAM or glob == head else ("gram", longest[:GRAM]) if len(longest) >= GRAM else ("head", head) if head else ("none", "")
        rows.append((number, "^" + fnmatch.translate(glob).replace("\\Z", "\\z"), kind, text))
    return spark.createDataFrame(rows, "rule int, regex string, kind string, text string")


def proposals(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule, regex): the rules whose text a key holds where it has to, of the distinct values of `key`."""
    distinct = keys.select("key").where("key is not null").distinct()
    # a row for each length that heads have
    lengths = rules.where("kind = 'head'").agg(F.array_sort(F.collect_set(F.length("text"))).alias("lengths"))
    cut = distinct.crossJoin(F.broadcast(lengths)).select("key", F.explode(F.filter("lengths", lambda n: n <= F.length("key"))).alias("n"))
    heads = cut.select("key", F.lit("head").alias("kind"), F.expr("substring(key, 1, n)").alias("text"))
    at = F.explode(F.sequence(F.lit(1), F.length("key") - GRAM + 1))
    grams = distinct.where(F.length("key") >= GRAM).select("key", at.alias("n")).select("key", F.lit("gram").alias("kind"), F.expr(f"substring(key, n, {GRAM})").alias("text")).distinct()
    every = distinct.select("key", F.lit("none").alias("kind"), F.lit("").alias("text"))
    return heads.unionByName(grams).unionByName(every).join(rules, ["kind", "text"]).select("key", "rule", "regex")


def first_rule(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule): the lowest number among the rules that match a key; keys that none matches have no row."""
    return proposals(keys, rules).where("rlike(key, regex)").groupBy("key").agg(F.min("rule").alias("rule"))
