"""Trees from dependency edges: order, depth and extent of each node, by list ranking.

The walk around a tree goes down and up each edge once. Each step of the walk
points to the next; pointers are doubled until all have met the end, and carry
sums of what lies before it. So a chain of a million words takes twenty joins, and
nothing recurses on the driver or gathers a tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.plans.shared import discard, written


def dependency_trees(edges: DataFrame) -> DataFrame:
    """tree, node, parent, label, node_id, last_id, ord, depth: the nodes below the root of each tree, as rows of ``sources.penn``.

    edges: tree, parent, child, label. Children go by their number; a child with
    several parents keeps the least. Nodes that no root reaches, as those on a cycle
    or below one, are left out; a root, a parent that is no child, has id 0.
    A tree with several roots is several trees, told apart by ``root``.
    """
    once = edges.groupBy("tree", "child").agg(F.min(F.struct("parent", "label")).alias("m")).select("tree", F.col("m.parent").alias("parent"), "child", F.col("m.label").alias("label"))
    family = Window.partitionBy("tree", "parent").orderBy("child")
    ranked = once.select("*", (F.row_number().over(family) - 1).alias("ord"), F.lead("child").over(family).alias("next"))
    firsts = once.groupBy("tree", F.col("parent").alias("child")).agg(F.min("child").alias("first"))
    inner = once.select("tree", F.col("child").alias("parent"), F.lit(True).alias("inner"))
    steps = written(ranked.join(firsts, ["tree", "child"], "left").join(inner, ["tree", "parent"], "left"), "steps")
    down = steps.select("tree", F.col("child").alias("at"), F.lit(True).alias("down"), F.coalesce("first", "child").alias("to"), F.col("first").isNotNull().alias("to_down"))
    up = steps.select("tree", F.col("child").alias("at"), F.lit(False).alias("down"), F.when(F.col("next").isNotNull(), F.col("next")).when(F.col("inner"), F.col("parent")).alias("to"), F.col("next").isNotNull().alias("to_down"))
    sums = [F.when(F.col("down"), 1).otherwise(0).cast("long").alias("downs"), F.when(F.col("down"), 1).otherwise(-1).cast("long").alias("level")]
    roots = steps.where("inner is null").select("tree", F.col("child").alias("at"), F.lit(False).alias("down"), F.when(F.col("next").isNull(), F.col("parent")).alias("root"))
    walk = down.unionByName(up).select("*", *sums).join(roots, ["tree", "at", "down"], "left")
    now = written(walk, "walk")
    size = now.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(size.bit_length()):
        if now.where("to is not null").isEmpty():
            break
        ahead = now.select("tree", F.col("at").alias("to"), F.col("down").alias("to_down"), F.col("to").alias("__to"), F.col("to_down").alias("__down"), F.col("downs").alias("__downs"), F.col("level").alias("__level"), F.col("root").alias("__root"))
        both = now.join(ahead, ["tree", "to", "to_down"], "left")
        last, now = now, written(both.select("tree", "at", "down", F.col("__to").alias("to"), F.col("__down").alias("to_down"), (F.col("downs") + F.coalesce("__downs", F.lit(0))).alias("downs"), (F.col("level") + F.coalesce("__level", F.lit(0))).alias("level"), F.coalesce("root", "__root").alias("root")), "walk")
        discard(last)
    ended = now.where("to is null and root is not null")
    whole = Window.partitionBy("tree", "root")
    counted = ended.select("*", F.max("downs").over(whole).alias("all"))
    entered = counted.where("down").select("tree", F.col("at").alias("child"), "root", (F.col("all") - F.col("downs") + 1).cast("int").alias("node_id"), (1 - F.col("level")).cast("int").alias("depth"))
    left = counted.where("not down").select("tree", F.col("at").alias("child"), (F.col("all") - F.col("downs")).cast("int").alias("last_id"))
    out = entered.join(left, ["tree", "child"]).join(steps.select("tree", "child", "parent", "label", "ord"), ["tree", "child"])
    return out.select("tree", "root", F.col("child").alias("node"), "parent", "label", "node_id", "last_id", "ord", "depth")
