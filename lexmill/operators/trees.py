"""Tree operators on node rows (see ``sources.penn``): all are selections, windows or joins by sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import link_ids, plain_tag


def root(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is null")


def leaves(nodes: DataFrame) -> DataFrame:
    """sent_id, idx, tag, word."""
    return nodes.where("is_leaf").select("sent_id", F.col("b").alias("idx"), "tag", "word")


def inner(nodes: DataFrame) -> DataFrame:
    return nodes.where("not is_leaf")


def subtree_pairs(nodes: DataFrame) -> DataFrame:
    """sent_id, top, node_id: every node with each node of its subtree, itself included."""
    tops = _gathered(nodes).select("sent_id", "ranges", F.explode("ranges").alias("t"))
    below = F.filter("ranges", lambda x: x["node_id"].between(F.col("t.node_id"), F.col("t.last_id")))
    return tops.select("sent_id", F.col("t.node_id").alias("top"), F.explode(below).alias("x")).select("sent_id", "top", "x.node_id")


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """sent_id, top, n: how many nodes each subtree has, its top included."""
    sizes = F.transform("ranges", lambda t: F.struct(t["node_id"].alias("top"), F.size(F.filter("ranges", lambda x: x["node_id"].between(t["node_id"], t["last_id"]))).cast("long").alias("n")))
    return _gathered(nodes).select("sent_id", F.inline(sizes))


def _gathered(nodes: DataFrame) -> DataFrame:
    """sent_id, ranges (node_id, last_id): one row a sentence."""
    return nodes.groupBy("sent_id").agg(F.collect_list(F.struct("node_id", "last_id")).alias("ranges"))


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds prev_id, next_id, first_child and last_child."""
    family = Window.partitionBy("sent_id", "parent_id").orderBy("ord")
    children = nodes.where("parent_id is not null").groupBy("sent_id", F.col("parent_id").alias("node_id")).agg(F.min_by("node_id", "ord").alias("first_child"), F.max_by("node_id", "ord").alias("last_child"))
    return nodes.withColumns({"prev_id": F.lag("node_id").over(family), "next_id": F.lead("node_id").over(family)}).join(children, ["sent_id", "node_id"], "left")


def path_to_leaf(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """sent_id, idx, node_id, depth, tag: the nodes from the root to a leaf. asked: sent_id, idx."""
    return asked.join(nodes.select("sent_id", "node_id", "depth", "tag", "b", "e"), "sent_id").where("b <= idx and idx < e").drop("b", "e")


def at_range(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Nodes with exactly the span asked for, and rank: 1 is the outermost."""
    rank = F.row_number().over(Window.partitionBy("sent_id", "b", "e").orderBy("node_id"))
    return nodes.join(asked.select("sent_id", "b", "e").distinct(), ["sent_id", "b", "e"]).withColumn("rank", rank)


def maximal_in_range(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """sent_id, rb, re, node_id, b, e: the topmost nodes that lie inside a span. asked: sent_id, rb, re."""
    held = nodes.join(asked, "sent_id").where("b >= rb and e <= re and e > b")
    parents = held.select("sent_id", "rb", "re", F.col("node_id").alias("parent_id"))
    return held.join(parents, ["sent_id", "rb", "re", "parent_id"], "left_anti").select("sent_id", "rb", "re", "node_id", "b", "e")


def climb(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """The node that is ``h`` steps above leaf ``idx``, whose own node counts as step 0. asked: sent_id, idx, h."""
    leaf = nodes.where("is_leaf").select("sent_id", F.col("b").alias("idx"), F.col("depth").alias("leaf_depth"))
    above = path_to_leaf(nodes, asked.select("sent_id", "idx").distinct())
    return asked.join(leaf, ["sent_id", "idx"]).join(above, ["sent_id", "idx"]).where("depth = leaf_depth - h").drop("leaf_depth", "depth")


def remove_subtree(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes outside of the subtrees of ``tops`` (sent_id, node_id)."""
    gone = subtree_pairs(nodes).join(tops.select("sent_id", F.col("node_id").alias("top")), ["sent_id", "top"]).select("sent_id", "node_id")
    return nodes.join(gone, ["sent_id", "node_id"], "left_anti")


def linked_phrases(nodes: DataFrame) -> DataFrame:
    """sent_id, link, b, e: phrases whose tag carries a link number."""
    return nodes.where("not is_leaf").select("sent_id", F.explode(link_ids(F.col("tag"))).alias("link"), "b", "e")


def traces(nodes: DataFrame) -> DataFrame:
    """sent_id, idx, trace, link of trace leaves."""
    parts = F.split("word", "-")
    return nodes.where("is_leaf and tag = '-NONE-'").select("sent_id", F.col("b").alias("idx"), parts[0].alias("trace"), F.when(F.get(parts, 1).rlike("^[0-9]+$"), F.get(parts, 1).cast("int")).alias("link"))


def trace_targets(nodes: DataFrame) -> DataFrame:
    """sent_id, idx, b, e: the phrase that each linked trace stands for."""
    return traces(nodes).where("link is not null").join(linked_phrases(nodes), ["sent_id", "link"]).select("sent_id", "idx", "link", "b", "e")


def excluded_leaves(nodes: DataFrame) -> DataFrame:
    """sent_id, idx: traces, and tokens joined by hyphens to one before them."""
    words = nodes.where("is_leaf").select("sent_id", F.col("b").alias("idx"), "tag")
    order = Window.partitionBy("sent_id").orderBy("idx")
    before = F.lag("tag").over(order)
    joined = before.isNotNull() & ((F.col("tag") == "HYPH") | (before == "HYPH"))
    return words.withColumn("__out", (F.col("tag") == "-NONE-") | joined).where("__out").select("sent_id", "idx")


def hyphen_groups(nodes: DataFrame) -> DataFrame:
    """sent_id, idx, group: leaves in runs that hyphens join; a run is named by its first leaf."""
    order = Window.partitionBy("sent_id").orderBy("b")
    before = F.lag("tag").over(order)
    joined = F.coalesce((F.col("tag") == "HYPH") | (before == "HYPH"), F.lit(False))
    marked = nodes.where("is_leaf").withColumn("__first", F.when(~joined | before.isNull(), F.col("b")))
    return marked.select("sent_id", F.col("b").alias("idx"), F.last("__first", True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("group"))


def term_ranges(nodes: DataFrame) -> DataFrame:
    """sent_id, node_id, first, last: the first and last word of each node, both included."""
    return nodes.where("e > b").select("sent_id", "node_id", F.col("b").alias("first"), (F.col("e") - 1).alias("last"))


def with_tag(nodes: DataFrame, tag: str, leaf: bool) -> DataFrame:
    """Leaves of a part of speech, or phrases of a kind (function marks aside)."""
    own = F.col("tag") if leaf else plain_tag(F.col("tag"))
    return nodes.where(F.col("is_leaf") == leaf).where(own == tag)


def with_lemma(nodes: DataFrame, lemma: str) -> DataFrame:
    return nodes.where("is_leaf").where(F.col("lemma") == lemma)


def adjusted_leaves(nodes: DataFrame) -> DataFrame:
    """sent_id, idx, kept, adjusted: each leaf's ordinal without the excluded leaves before it."""
    words = nodes.where("is_leaf").select("sent_id", F.col("b").alias("idx"))
    marked = words.join(excluded_leaves(nodes).withColumn("__x", F.lit(1)), ["sent_id", "idx"], "left")
    order = Window.partitionBy("sent_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.coalesce("__x", F.lit(0))).over(order), F.lit(0))
    return marked.select("sent_id", "idx", F.col("__x").isNull().alias("kept"), (F.col("idx") - gone).cast("int").alias("adjusted"))


def with_lemmas(nodes: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Leaves with their lemma. lemmas: sent_id, idx, lemma."""
    return nodes.join(lemmas.select("sent_id", F.col("idx").alias("b"), F.lit(True).alias("is_leaf"), "lemma"), ["sent_id", "b", "is_leaf"], "left")


def matched_arguments(nodes: DataFrame, gold: DataFrame, arguments: DataFrame) -> DataFrame:
    """sent_id, label, b, e, node_id: parser nodes that make up the gold span of each argument.

    gold: node rows of the annotated tree (with traces); arguments: sent_id, label,
    idx, h in that tree. Spans are moved past the excluded leaves; a trace is
    looked up where its link points.
    """
    spans = climb(gold, arguments).join(gold.select("sent_id", "node_id", "b", "e"), ["sent_id", "node_id"]).select("sent_id", "label", "b", "e")
    moved = trace_targets(gold).select("sent_id", F.col("idx").alias("b"), (F.col("idx") + 1).alias("e"), F.col("b").alias("tb"), F.col("e").alias("te"))
    spans = spans.join(moved, ["sent_id", "b", "e"], "left").select("sent_id", "label", F.coalesce("tb", "b").alias("b"), F.coalesce("te", "e").alias("e")).distinct()
    kept = adjusted_leaves(gold).where("kept").select("sent_id", "idx", "adjusted")
    asked = spans.join(kept, "sent_id").where("idx >= b and idx < e").groupBy("sent_id", "label", "b", "e").agg(F.min("adjusted").alias("rb"), (F.max("adjusted") + 1).alias("re"))
    found = maximal_in_range(nodes, asked.select("sent_id", "rb", "re").distinct())
    return asked.select("sent_id", "label", "rb", "re").join(found, ["sent_id", "rb", "re"]).select("sent_id", "label", "b", "e", "node_id")


def with_siblings_like(nodes: DataFrame, test: Column, backward: bool = False) -> DataFrame:
    """Adds siblings (node ids of those after each node, or before it, that pass the test, the nearest first) and nearest."""
    rest = [c for c in nodes.columns if c != "sent_id"]
    fits = F.coalesce(test & F.col("parent_id").isNotNull(), F.lit(False))
    rows = nodes.groupBy("sent_id").agg(F.collect_list(F.struct(*rest, fits.alias("__fits"))).alias("nodes"))
    others = F.transform(F.filter("nodes", lambda x: x["__fits"]), lambda x: F.struct(x["ord"].alias("ord"), x["node_id"].alias("node_id"), x["parent_id"].alias("parent_id")))
    rows = rows.withColumn("others", F.sort_array(others, asc=not backward))

    def family(x: Column) -> Column:
        further = lambda y: (y["ord"] < x["ord"]) if backward else (y["ord"] > x["ord"])
        found = F.filter("others", lambda y: (y["parent_id"] == x["parent_id"]) & further(y))
        return F.struct(*[x[c].alias(c) for c in rest], F.transform(found, lambda y: y["node_id"]).alias("siblings"))

    return rows.select("sent_id", F.inline(F.transform("nodes", family))).withColumn("nearest", F.get("siblings", 0))
