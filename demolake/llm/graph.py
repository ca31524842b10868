"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demolake.llm.scratch import delete, stored


def components(edges: DataFrame, name: str = "components", limit: int | None = None) -> DataFrame:
    """Columns node, root (the smallest node reachable) for every node of the edges (a, b) that has another's number.

    With a ``limit`` of rounds it may stop early: every root is then still reachable
    from its node, but need not be the smallest, and a node may have several.

    Each round keeps at most one edge per edge before, so hubs and long chains
    stay linear; a node's smallest neighbour is found by a partial aggregation.
    """
    spark = edges.sparkSession
    edges, path = stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    state, rounds = None, 0
    while True:
        rounds += 1
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u AND v != m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        small = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        stars = large.join(small, F.col("b") == F.col("u")).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a != b").distinct()
        before = path
        edges, path = stored(stars, name)
        delete(spark, before)
        if rounds == limit:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = now
