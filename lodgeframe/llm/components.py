"""Connected components of a links table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.storage import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's (large: greater; small: smaller or own) neighbours hang on to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    if large:
        # Stored, so that Spark can split the partition of a node with very many neighbours.
        least = stored(least, "least")
        linked = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = both.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return linked.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached, for every node of ``links`` (u, v: long).

    Each round is two joins and is written to the shared folder, so a lost executor costs one round. The
    rounds grow with the logarithm of the longest chain, and end when a round changes nothing.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "links")
    before = _state(edges)
    while before[0]:
        edges = stored(_star(stored(_star(edges, large=True), "large"), large=False), "small")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
