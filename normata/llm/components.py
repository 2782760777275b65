"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normata.llm.common import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Each round hangs a node's larger neighbours, then all its neighbours, on the smallest one, until
    every edge leads to a root; rounds grow with the logarithm of the longest path. A round's edges are
    written to the shared folder and those of the round before deleted. Rows with nulls are left out; an
    empty table gives no rows; a self edge gives a component of its own.
    """
    kept = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a IS NOT NULL AND b IS NOT NULL")
    now = materialise(kept.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not is_forest(now):
        after = materialise(small_star(large_star(now)), "edges")
        discard(now)
        now = after
    every = now.union(now.select("b", "b"))  # a node may have an edge to itself and one to its root
    return every.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def is_forest(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and that one none: stars on their roots."""
    up = edges.where("a <> b")
    at = up.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(up.select("b", F.lit(0)))
    tall = at.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("least")).where("n > 1 OR n = 1 AND least = 0")
    return tall.isEmpty()


def large_star(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on the smallest node near it."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("a", "b")
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b >= a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b"))
    ).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()
