"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label is the component's smallest node.

    Alternating large-star and small-star steps: each node hands its smallest neighbour to
    the larger ones, then to the smaller ones. Stars come out after a number of rounds that
    grows with the logarithm of the longest path. Minima are aggregated before the shuffle, so
    a node with very many edges is no burden, and its join is split by adaptive execution.
    Every round is written to the checkpoint folder.
    """
    ends = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    pairs = checkpointed(
        ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = None
    while (now := _state(pairs)) != state:
        state = now
        pairs = checkpointed(_small_star(_large_star(pairs)))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def _state(pairs: DataFrame) -> tuple:
    digest = F.xxhash64("u", "v").cast("decimal(20)")
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(digest)).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u")
    kept = least.select("u", F.col("m").alias("v"))
    others = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(others).distinct()
