"""Connected components of a graph of 64-bit nodes, by alternating star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them. ``b`` is the smaller end."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node that has an edge, with the smallest node of its component.

    ``edges`` has ``a`` and ``b``; direction, repetition and loops do not matter. Every round is two
    aggregations with partial sums and two joins on their result, so a node with a great many
    neighbours is pre-aggregated, and its side of the join is one that adaptive execution splits.
    Each round ends in a table of the shared folder; the one before it is deleted.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    current = written(ordered, "edges")
    before = None
    while True:
        size = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
        if before == size:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = size
        larger = _large_star(current).distinct()
        following = written(_small_star(larger).distinct(), "edges")
        drop_written(current)
        current = following
