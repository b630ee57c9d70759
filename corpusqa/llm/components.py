"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.session import settle

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    # every larger neighbour of u is tied to the smallest of u and its neighbours
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return (
        both.join(low, "a").filter(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    # u and its smaller neighbours are tied to the smallest of them
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    tied = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
    return tied.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``links`` (columns a, b).

    Nodes without a link to another node do not appear. The result is a star forest that is
    written out each round, so a lost executor repeats one round only; minima merge inside the
    tasks, so a node with any number of links sends one row per task. Links with a null end
    are ignored. No links: no rows.
    """
    edges = settle(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        # done when every node has one neighbour below it, and that is no one's larger end
        stars = edges.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n"))
        lower = edges.select(F.col("b").alias("a")).distinct()
        if stars.filter("n > 1").isEmpty() and edges.join(lower, "a", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        edges = settle(_small_star(_large_star(edges)))
    raise RuntimeError("components did not settle")
