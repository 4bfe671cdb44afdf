"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from molspark.staging import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label``: every node of a link, with the smallest node it reaches.

    Links are undirected; self-links, repeated links and links with a null end
    add nothing. Each round replaces the links by an equivalent set that is
    nearer to stars around the smallest nodes (two aggregations and two joins on
    the links alone) and is written to the shared folder, so no lineage grows.
    A node of many links is aggregated before the shuffle.
    """
    x, y = F.col(a), F.col(b)
    edges = stage(
        links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links"
    )
    state = _state(edges)
    while state[0]:
        edges = stage(_small_star(_large_star(edges)), "stars")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node with the smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours with the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
