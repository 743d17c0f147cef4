"""Connected components of an edge table by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for each node of edges(a, b); nodes without an edge aren't in it.

    A round points every neighbour of a node to the smallest one; only minima and edges move, never groups, so a node
    with very many neighbours is a skewed join at most. Each round is written to the shared folder and read again; the
    round before it is deleted then.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        e = both(e)
        least = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return e.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        to = e.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        return to.filter("a <> b").distinct()

    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    state = None
    while True:
        before, now = now, materialise(small(large(now)), "cc")
        discard(now.sparkSession, before)
        sums = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if sums == state or not sums[0]:
            break
        state = sums
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
