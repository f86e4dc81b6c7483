"""Connected components of an edge table, without collecting any of it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trophos.plans.scratch import Scratch


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct edges, each from its larger to its smaller end."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for each end of ``edges(a, b)``; component is the smallest id.

    Rounds of large-star and small-star steps.  The smallest neighbour of a node
    is an aggregate with map-side combine, so the many edges of one node are not
    brought together to find it.  It is written before it is joined back, so
    that both sides of the join are shuffled for it alone and Spark may split a
    skewed one.  Every round is written to the shared folder.  The
    rounds end when each node hangs directly on a smallest one; their number
    grows with the logarithm of the longest chain.
    """
    state = scratch.keep(_directed(edges))
    while not _stars(state):
        # large star: larger neighbours of a node move to its smallest, which may be itself
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("m"))
        least = scratch.keep(least)
        large = state.join(least, F.col("b") == F.col("node")).select("a", F.col("m").alias("b"))
        large = large.union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
        large = scratch.keep(large.where("a <> b").distinct())
        # small star: smaller neighbours of a node, and itself, move to its smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = scratch.keep(small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    labels = state.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels.union(state.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour that has none itself."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select(F.col("b").alias("id"), F.lit(0), F.lit(1)))
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or up = 1 and down = 1").isEmpty()
