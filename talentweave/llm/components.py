"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of (a, b), the root being the smallest node of its component.

    Each round hangs larger neighbours onto the smallest neighbour of a node, then does so for smaller ones, until every
    edge leads to a root. Minima are aggregated before they are joined back, so a node with many neighbours needs no task
    that holds them all. The number of rounds grows with the logarithm of the nodes; a state that hasn't settled after
    `rounds` is an error, never a result.
    """
    ordered = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.save(ordered(edges), f"{name}_0")
    seen = None
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.save(ordered(large), f"{name}_{k}_large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        after = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = scratch.save(ordered(after), f"{name}_{k}")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}_{k - 1}", f"{name}_{k}_large")
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
