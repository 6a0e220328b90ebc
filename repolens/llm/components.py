"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, tmp: Scratch, name: str = "star", rounds: int = 100) -> DataFrame:
    """edges: u, v of one ordered type. Returns (node, root) of every node that isn't the least of its component.

    Self-loops and repeated edges don't matter; an empty table gives an empty one. Each round shuffles the edges on one end, with minima combined before the shuffle, and writes them to the shared folder. The number of rounds grows with the logarithm of the components' diameter; nothing but a count and a checksum reaches the driver.
    """
    now = tmp.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    before, state = None, _state(now)
    for k in range(1, rounds + 1):
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = tmp.save(both.groupBy("u").agg(F.min("v").alias("m")), f"{name}m{k}").select("u", F.least("u", "m").alias("m"))
        large = tmp.save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}l{k}")
        least = tmp.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}s{k}")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = tmp.save(small.distinct(), f"{name}{k}")
        tmp.drop(f"{name}m{k}", f"{name}l{k}", f"{name}s{k}", f"{name}{k - 1}")
        now, before, state = after, state, _state(after)
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
