"""Connected components of an edge table, without collecting edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import join_hot, materialize


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star: each round every node points at the
    smallest neighbour it knows, so the rounds grow with the logarithm of the longest
    chain. Groups are reduced by partial aggregates, and the neighbours of a hot node stay where they are
    when they are told its smallest one. Each round is written to the shared
    folder. An empty edge table gives no rows; self-loops and nulls are ignored.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "cc")
    seen = _digest(e)
    for _ in range(max_rounds):
        # large star: each neighbour larger than the node moves to the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both.where("v > u"), low, ["u"], "n", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the neighbours not above the node move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, least, ["u"], "n", seen[0]).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u > v").distinct()
        e = materialize(small, "cc")
        seen, before = _digest(e), seen
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _digest(e: DataFrame) -> tuple:
    """Enough to tell two edge tables apart: count and two sums of hashes."""
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND(F.lit(0xFFFFF)))).first())
