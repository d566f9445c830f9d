"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.session import materialize


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the vertex's least neighbour."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex, are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every vertex that is not the least of its component. ``links`` has columns a, b.

    Each round writes its links, so lineage stays short and a lost executor costs one round. Links shrink to
    stars; the number of rounds grows with the logarithm of the longest chain.
    """
    mark = None
    stars = links
    while True:
        stars = materialize(_small_star(_large_star(stars)), "stars")
        seen = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if seen == mark:
            return stars.select(F.col("a").alias("id"), F.col("b").alias("component"))
        mark = seen
