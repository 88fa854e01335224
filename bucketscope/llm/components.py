"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketscope.llm.tables import removed, stored


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """edges (a > b). Small star: each node's smaller neighbours go to the least of them; large star: its larger ones."""
    if small:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m"))
    else:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("x"), "m")
    return moved.filter("x != m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> (node, root): every node that has a link, and the least node it reaches.

    Null ends and self links are dropped; repeated links count once. Each round is written to
    the shared folder; the rounds grow with the logarithm of the largest component.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    before = None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        before, last = state, edges
        edges = stored(_stars(_stars(edges, small=False), small=True))
        removed(last)
