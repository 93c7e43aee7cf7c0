"""Connected components as a table, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

#: Parts that the edges at one node are dealt to, so that a star's centre isn't one task's work.
SALT = 16


def _looked_up(edges: DataFrame, low: DataFrame) -> DataFrame:
    """`edges` (a, b) that have a row (a, m) in `low`, with m. Edges are dealt by (a, part of b); `low` has a row an node,
    sent to every part."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int"))
    return dealt.join(low.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["a", "part"]).drop("part")


def components(edges: DataFrame) -> DataFrame:
    """(s, root): the lowest member of each node's connected component, by alternating large and small stars; nodes that
    are their own root have no row."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first()
    old = mark(edges)
    while old[0]:
        # large star: what lies above a node that has a lower neighbour goes to the lowest of these
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        moved = _looked_up(turned, low).select(F.col("b").alias("a"), F.col("m").alias("b"))
        stay = turned.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int"))
        stay = stay.join(low.select("a", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part")), ["a", "part"], "left_anti").select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = materialize(moved.unionByName(stay).where("a <> b").distinct(), "components")
        # small star: a node's lower neighbours, and itself, hang on the lowest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _looked_up(large, low).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialize(small, "components")
        now = mark(edges)
        if now == old:
            break
        old = now
    return edges.select(F.col("a").alias("s"), F.col("b").alias("root"))
