"""Connected components of an edge table, without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import shared


def _only_stars(forest: DataFrame) -> bool:
    """Whether every a has one b only, which is no a itself."""
    ends = forest.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(forest.select(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, comp): the smallest id reachable from each id that edges(a, b) mention.

    Alternating star contraction: large stars link each node's greater neighbours to its least
    neighbour, small stars its smaller ones, until only stars are left (in a few rounds, logarithmic in
    the number of nodes). Both steps are a min-aggregation and an equi-join on the node, merged and never
    broadcast, since edges grow with the data; every round is written to the shared folder, and the one before it deleted.
    """
    forest = shared.staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _only_stars(forest):
        both = forest.unionAll(forest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Staged, so that Spark can split the join at a node with many neighbours.
        least = shared.staged(both.groupBy("a").agg(F.min("b").alias("m")), name + "-least")
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(down.select("a", F.col("m").alias("b"))).distinct()
        before, forest = forest, shared.staged(small, name)
        shared.remove(edges.sparkSession, before, least)
    roots = forest.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return forest.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionAll(roots)
