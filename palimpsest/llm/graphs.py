"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of ``edges`` (a, b: long); the label is the component's least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): hubs are only ever reduced with min, which is
    combined before the shuffle, and joined, where Spark splits hot keys. Each round is a table in the shared folder.
    Self-links give no node; nulls are skipped; no edges give no rows.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    before = state(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        # dealt out anew, so that both sides of the join come from exchanges and Spark can split a hub's links
        least = least.hint("rebalance")
        large = both.filter("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_a")
        small = large.join(least, F.col("a") == F.col("_a")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = stored(small.filter("a <> b").distinct(), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
