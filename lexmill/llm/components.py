"""Connected components by alternating large and small stars (Kiveris et al., 2014).

Edges stay in Spark; every round is written to the shared folder. A node's
smallest neighbour comes from an aggregate with partial minima, and the joins
are plain equi-joins with one row a node on one side, whose skewed partitions
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import checkpointed, discard

MOST_ROUNDS = 60


def _digest(edges: DataFrame) -> tuple:
    """Count, sum and exclusive or of hashes. Of 56 bits their sum overflows from 200,000 edges or so; 32 bits leave room for 2^31 edges."""
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(mixed, 32)), F.bit_xor(mixed)).first())


def components(edges: DataFrame) -> DataFrame:
    """node, label: every node of the edges (a, b) with the smallest node of its component."""
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        last, now = now, checkpointed(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        discard(last)
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
