"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins each node's larger neighbours to the least node beside it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_least_neighbour(both), "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _least_neighbour(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``; root is the component's least node.

    Rounds of large and small stars; each halves what is left, so the number
    of rounds grows with the logarithm of the longest chain. Minima are
    aggregated before the shuffle and joined back, so a node with very many
    links never gathers them in one group. Self links and repeated links are
    harmless; an empty table gives an empty result. Each round is
    checkpointed, so a lost executor costs one round at most.
    """
    edges = checkpointed(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    )

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        edges = checkpointed(_small_star(_large_star(edges)))
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(tops)
