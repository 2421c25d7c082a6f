"""Connected components of links by alternating large and small stars, each round a checkpointed Spark job; nothing goes to the driver but sums."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, staged


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of `links` (a, b), root being the least node that it reaches.

    Each round makes every node point to a lower one of its neighbourhood; star-shaped groups of any size are done in two or three rounds.
    Null ends and loops are no links. No links give no rows.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").union(low.select("hi", F.col("m").alias("lo"))).distinct()
        following = staged(small, "links")
        now = tuple(following.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if seen is not None:
            discard(edges)
        edges = following
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct())
