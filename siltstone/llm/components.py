"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _lowest(edges: DataFrame) -> DataFrame:
    both = edges.select("hi", "lo").union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("low")).select("hi", F.least("hi", "low").alias("low"))
    # every neighbour above a node goes to the node's lowest neighbour
    star = both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
    return star.where("hi != lo").distinct()


def _raise(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("low"))
    tied = edges.join(least, "hi").where("lo != low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
    return tied.union(least.select("hi", F.col("low").alias("lo"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) of longs -> (id, component): component is the smallest id reachable. Ids without edges are absent.

    Each round is written to the shared folder and the one before it deleted; nothing
    but two numbers a round reaches the driver.
    """
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    mark = None
    for _ in range(most_rounds):
        r = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if tuple(r) == mark or not r[0]:
            break
        mark = tuple(r)
        before, now = now, materialise(_raise(_lowest(now)))
        release(before)
    else:
        raise RuntimeError("components did not settle")
    # settled edges form stars: (member, centre)
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(now.select("lo", F.col("lo")).distinct())
