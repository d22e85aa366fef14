"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014), all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.common import Scratch

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    onward = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return onward.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that has an edge; edges has columns a and b (long). The root is the smallest node.

    Each round is written to the shared folder. Loops and repeated edges are dropped; an empty table has no components.
    """
    tidy = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = scratch.write(tidy(edges), "edges-0"), None
    for k in range(1, MOST_ROUNDS):
        now = scratch.write(tidy(_small_star(tidy(_large_star(now)))), f"edges-{k}")
        scratch.drop(f"edges-{k - 1}")
        mark = now.select(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
    raise RuntimeError("components did not settle")
