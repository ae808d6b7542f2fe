"""Connected components of a distributed edge table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.stored import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node gets the least node around it."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours get the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (
        down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        .unionAll(least.select("a", F.col("m").alias("b"))).distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): root is the least node that can be reached.

    Nodes of no edge are not in the result; loops and repeated edges do no harm.
    Least neighbours are combined before each shuffle, so a hub's edges never
    meet in one task; each round is written, so that no lineage builds up and a
    lost executor costs one round. Few rounds are needed: their number grows
    with the logarithm of the number of nodes.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "stars")
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == seen:
            break
        seen = (row[0], row[1])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
