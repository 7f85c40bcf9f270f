"""Connected components of a link table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.store import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns ``id, component`` for each id in ``links (a, b)``; component is the smallest id reachable.

    Each round hooks larger neighbours, then smaller ones, to the least
    neighbour, both by grouped minimum and a join, so that no group of
    neighbours is ever collected. Rounds grow with the logarithm of the
    longest chain. Links of an id to itself say nothing.
    """
    table = scratch.write(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = table.union(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: every neighbour above the node goes to the node's least neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        one = scratch.write(large, "large")
        # small star: every neighbour below the node, and the node, go to the least
        low = one.groupBy("a").agg(F.min("b").alias("m"))
        small = one.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        two = scratch.write(small, "small")
        scratch.drop(one)
        # done when each id has one link, to a centre that has none itself
        hangs = two.where("a <> b").join(two.where("a <> b").select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a")
        torn = two.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low < high").select("a")
        unstable = hangs.union(torn).limit(1).count()
        scratch.drop(table)
        table = two
        if not unstable:
            break
    stars = table.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("id"), "component").union(stars.select(F.col("component").alias("id"), "component").distinct())
