"""Connected components by alternating stars (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwatch.session import materialize


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _distinct(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _distinct(moved.union(least.toDF("a", "b")))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the component's least node, for nodes with edges; ``edges`` has two orderable columns a, b.

    Each round is two minima per node with map-side sums and a join with
    them, so a node of any number of edges is never gathered; the edges are
    written after each round.  Ends when a round changes nothing.
    """
    now, before = materialize(_distinct(edges.toDF("a", "b")), "edges"), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.toDF("node", "root").union(now.select("b", "b").distinct())
        before = seen
        now = materialize(_small_star(_large_star(now)), "edges")
