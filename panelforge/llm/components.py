"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # neighbours above a node move to its smallest neighbour
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.where("v > u").join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    large = large.where("u <> v").distinct()
    # a node and its neighbours below move to the smallest of them
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return small.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``u, v``) but the roots; a root is its component's smallest node.

    A node with very many links is a hot key of joins only, which Spark splits.
    Every round is a written table; the rounds grow with the logarithm of the
    longest path.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "links")
    before = _state(edges)
    while before[0]:
        edges = materialize(_stars(edges), "stars")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
