"""Directed graphs as tables ``edges(src, dst)``: neighbours, reachability, walks, meeting paths, hubs, islands.

Loops keep their state in the shared folder, one table a level, and extend only
new nodes; hubs are best removed first (``without_hubs``), as each walk through
one multiplies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.plans.shared import written

#: Links in a block of neighbour lists at most, on average, and the least number of blocks.
BLOCK_LINKS = 2_000_000
LEAST_BLOCKS = 8


def neighbours(edges: DataFrame, nodes: DataFrame | None = None, backward: bool = False) -> DataFrame:
    """node, neighbour: distinct direct neighbours of ``nodes`` (all, if none are given)."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("neighbour")).distinct()
    return pairs if nodes is None else pairs.join(nodes.select("node"), "node", "left_semi")


def reachable(edges: DataFrame, starts: DataFrame, cutoff: int | None, backward: bool = False) -> DataFrame:
    """start, node, distance: every node within ``cutoff`` hops of a start (column ``node``; any number, if None), with its least distance."""
    step = neighbours(edges, backward=backward)
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("distance")).distinct()
    frontier = seen
    for hop in count(1) if cutoff is None else range(1, cutoff + 1):
        found = frontier.select("start", "node").join(step, "node").select("start", F.col("neighbour").alias("node")).distinct()
        frontier = written(found.join(seen, ["start", "node"], "left_anti").withColumn("distance", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hop % 16 == 0:  # else the plan grows with every level
            seen = written(seen, "seen")
    return seen


def walks(edges: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """start, path: all walks of 0 to ``length`` hops; nodes may recur. Newest node last."""
    step = edges.select(F.col("src").alias("__at"), "dst")
    now = starts.select(F.col("node").alias("start"), F.array("node").alias("path"))
    out = now
    for _ in range(length):
        now = now.join(step, F.element_at("path", -1) == F.col("__at")).select("start", F.concat("path", F.array("dst")).alias("path"))
        out = out.unionByName(now)
    return out


def meeting_nodes(edges: DataFrame, pairs: DataFrame, reach: int) -> DataFrame:
    """a, b, node, da, db: nodes that both ends of a pair reach within ``reach`` hops."""
    starts = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    near = reachable(edges, starts, reach)
    left = pairs.join(near.select(F.col("start").alias("a"), "node", F.col("distance").alias("da")), "a")
    return left.join(near.select(F.col("start").alias("b"), "node", F.col("distance").alias("db")), ["b", "node"])


def most_similar(scored: DataFrame, by: list[str], cutoff: float) -> DataFrame:
    """Of each group the largest (score, ref, candidate), if its score is above ``cutoff``."""
    best = scored.groupBy(*by).agg(F.max(F.struct("score", "ref", "candidate")).alias("m"))
    return best.select(*by, "m.score", "m.ref", "m.candidate").where(F.col("score") > cutoff)


def interior_counts(paths: DataFrame) -> DataFrame:
    """node, n: how often each node is inside of a path (neither first nor last)."""
    inner = paths.select(F.explode(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))).alias("node"))
    return inner.groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def hub_nodes(paths: DataFrame, top: int) -> DataFrame:
    """node, n: the nodes most often inside of paths."""
    return interior_counts(paths).orderBy(F.col("n").desc(), "node").limit(top)


def without_hubs(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """Edges whose target is no hub."""
    return edges.join(hubs.select(F.col("node").alias("dst")), "dst", "left_anti")


def ancestors(links: DataFrame, most_levels: int | None = None) -> DataFrame:
    """sub, super: the reflexive transitive closure of links(sub, super); cycles end where nothing new comes."""
    edges = links.select(F.col("sub").alias("src"), F.col("super").alias("dst")).where("src is not null and dst is not null")
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return reachable(edges, nodes, most_levels).select(F.col("start").alias("sub"), F.col("node").alias("super"))


def islands(edges: DataFrame, nodes: DataFrame | None = None, most_rounds: int = 100) -> DataFrame:
    """node, island: weakly connected components, each named by its least node. Least labels spread and jump to their label's label."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()
    every = both.select("node") if nodes is None else both.select("node").unionByName(nodes.select("node"))
    labels = written(every.distinct().withColumn("island", F.col("node")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("other"), "island"), "other").groupBy("node").agg(F.min("island").alias("m"))
        spread = labels.join(near, "node", "left").select("node", F.least("island", F.coalesce("m", "island")).alias("island"), F.col("island").alias("was"))
        jump = spread.select(F.col("node").alias("island"), F.col("island").alias("further"))
        now = written(spread.join(jump, "island").select("node", F.least("island", "further").alias("island"), "was"), "labels")
        labels = now.select("node", "island")
        if now.where("island <> was").isEmpty():
            return labels
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def _aligned(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Full join of two tables of paths by their last node, the first path of a node with the first of the other side, and so on."""

    def ranked(paths: DataFrame, name: str) -> DataFrame:
        ends = paths.withColumn("__end", F.element_at("path", -1))
        rank = F.row_number().over(Window.partitionBy(*by, "__end").orderBy("path"))
        return ends.withColumn("__rank", rank).withColumnRenamed("path", name)

    return ranked(left, "left").join(ranked(right, "right"), [*by, "__end", "__rank"], "full")


def path_overlap(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """by, left, right: paths of both sides that end in the same node, paired by rank."""
    return _aligned(left, right, by).where("left is not null and right is not null").select(*by, "left", "right")


def meeting_paths(edges: DataFrame, pairs: DataFrame, half: int) -> DataFrame:
    """a, b, left, right: pairs of paths from both ends of a pair that meet, each at most ``half`` hops long.

    Both sides grow a hop a level. New paths are paired with the other side's
    new and older ones; only paths that met nothing new grow further.
    """
    step = edges.select(F.col("src").alias("__at"), "dst")

    def grown(paths: DataFrame) -> DataFrame:
        return paths.join(step, F.element_at("path", -1) == F.col("__at")).select("a", "b", F.concat("path", F.array("dst")).alias("path"))

    def unmatched(found: DataFrame, side: str, other: str) -> DataFrame:
        return found.where(F.col(side).isNotNull() & F.col(other).isNull()).select("a", "b", F.col(side).alias("path"))

    def ends(paths: DataFrame) -> DataFrame:
        return paths.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.element_at("path", -1).alias("__e")).distinct()

    def narrowed(first: DataFrame, second: DataFrame, how: str) -> DataFrame:
        """Rows of the second whose end is (``left_semi``) or isn't (``left_anti``) an end of the first."""
        known = ends(first)
        return second.join(known, (second["a"] == known["__a"]) & (second["b"] == known["__b"]) & (F.element_at(second["path"], -1) == known["__e"]), how)

    left, right = (pairs.select("a", "b", F.array(c).alias("path")) for c in ("a", "b"))
    old_left, old_right = left, right  # all paths that later ones may meet, frontier included
    met = None
    for _ in range(half):
        new_left, new_right = written(grown(left), "paths"), written(grown(right), "paths")
        both, late_right, late_left = (written(_aligned(x, y, ["a", "b"]), "aligned") for x, y in ((new_left, new_right), (old_left, new_right), (new_left, old_right)))
        for found in (both, late_right, late_left):
            pairs_met = found.where("left is not null and right is not null").select("a", "b", "left", "right")
            met = pairs_met if met is None else met.unionByName(pairs_met)
        l1, l3 = unmatched(both, "left", "right"), unmatched(late_left, "left", "right")
        r1, r2 = unmatched(both, "right", "left"), unmatched(late_right, "right", "left")
        old_left = old_left.unionByName(l1).unionByName(narrowed(l1, l3, "left_anti"))
        old_right = old_right.unionByName(r1).unionByName(narrowed(r1, r2, "left_anti"))
        left, right = narrowed(l1, l3, "left_semi"), narrowed(r1, r2, "left_semi")
    if met is None:
        return pairs.limit(0).select("a", "b", F.array("a").alias("left"), F.array("b").alias("right"))
    return met


def largest_island(labels: DataFrame) -> DataFrame:
    """The number of islands and the size of the largest."""
    sizes = labels.groupBy("island").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("islands"), F.max("n").alias("largest"))


def walk_ranks(edges: DataFrame, starts: DataFrame, rounds: int = 30, damping: float = 0.85) -> DataFrame:
    """start, node, rank: where a walk that returns to its start nodes is, for many starts at the same time.

    starts: start, node, weight: the start vector of each name, weights in proportion.
    Each round is one join on the node; a node without a way out sends all back to the
    start nodes. The tables grow by the nodes that the rounds reach.
    """
    total = Window.partitionBy("start")
    seeds = written(starts.groupBy("start", "node").agg(F.sum("weight").alias("weight")).select("start", "node", (F.col("weight") / F.sum("weight").over(total)).alias("seed")), "seeds")
    step = edges.select(F.col("src").alias("node"), "dst").distinct()
    step = written(step.join(step.groupBy("node").agg(F.count(F.lit(1)).alias("ways")), "node"), "steps")
    now = seeds.select("start", "node", F.col("seed").alias("rank"))
    for k in range(rounds):
        moved = now.join(step, "node").groupBy("start", F.col("dst").alias("node")).agg((F.sum(F.col("rank") / F.col("ways")) * damping).alias("rank"))
        kept = moved.groupBy("start").agg(F.sum("rank").alias("kept"))
        back = seeds.join(kept, "start", "left").select("start", "node", (F.col("seed") * (1 - F.coalesce("kept", F.lit(0.0)))).alias("rank"))
        last, now = now, moved.unionByName(back).groupBy("start", "node").agg(F.sum("rank").alias("rank"))
        if k % 4 == 3:  # else the plan grows with every round
            now = written(now, "ranks")
    return now


def shared_neighbour_choice(edges: DataFrame, mentions: DataFrame, allowed: DataFrame, cutoff: int = 3) -> DataFrame:
    """doc_id, mention, chosen: for each mention that may be several things, the one that shares most of the graph with a thing known in its document.

    mentions: doc_id, mention, item, resolved; allowed: mention, item (those whose class
    may be meant). Two things share the nodes that both are or link to; the best of
    (shared, known thing, candidate) must share more than ``cutoff`` and be allowed.
    Candidates meet known things within a document only. Neighbours are lists in blocks
    of items; a pair goes to the task of both its blocks, so lists are sent once a pair of
    blocks, never once a pair of things, and a task streams its pairs past two blocks.
    """
    known = mentions.where("resolved and item is not null").select("doc_id", F.col("item").alias("ref"))
    asked = mentions.where("not resolved and item is not null").select("doc_id", "mention", F.col("item").alias("candidate"))
    items = mentions.where("item is not null").select(F.col("item").alias("node")).distinct()
    near = neighbours(edges, items).withColumnRenamed("neighbour", "shared").where("node <> shared").unionByName(items.select("node", F.col("node").alias("shared")))
    near = written(near.groupBy("node").agg(F.collect_list("shared").alias("near")), "near")
    links = near.agg(F.sum(F.size("near"))).first()[0] or 0
    scored = _common_counts(asked.join(known, "doc_id"), near, max(LEAST_BLOCKS, -(-links // BLOCK_LINKS)))
    best = most_similar(scored.where(F.col("score") > cutoff), ["doc_id", "mention"], cutoff)
    return best.select("doc_id", "mention", F.col("candidate").alias("chosen"), "score").join(allowed.select("mention", F.col("item").alias("chosen")).distinct(), ["mention", "chosen"]).select("doc_id", "mention", "chosen", "score")


def _common_counts(pairs: DataFrame, near: DataFrame, blocks: int) -> DataFrame:
    """doc_id, mention, ref, candidate, score: how many nodes both lists hold, but for a thing that meets itself. Pairs without a common node are left out."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    types = dict(pairs.dtypes) | dict(near.dtypes)
    null = {c: F.lit(None).cast(types[c]).alias(c) for c in ("doc_id", "mention", "ref", "candidate", "near")}
    own = near.select("node", "near", block("node").alias("own"), every)
    lists = [own.select((F.col(a) * blocks + F.col(b)).alias("part"), F.lit(side).alias("side"), null["doc_id"], null["mention"], F.col("node").alias("ref"), null["candidate"], "near") for side, a, b in ((0, "own", "other"), (1, "other", "own"))]
    asked = pairs.select((block("ref") * blocks + block("candidate")).alias("part"), F.lit(2).alias("side"), "doc_id", "mention", "ref", "candidate", null["near"])
    dealt = lists[0].unionByName(lists[1]).unionByName(asked).repartition("part").sortWithinPartitions("part", "side")
    out = pairs.select("doc_id", "mention", "ref", "candidate").withColumn("score", F.lit(0).cast("long")).schema
    return dealt.mapInArrow(_count_common, out)


class _Lists:
    """Two blocks of lists, each node's list as a run of numbers; keys of the second are (row, number), sorted."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(batches)
        self.nodes, lists = [], []
        for side in (0, 1):
            own = table.filter(pc.equal(table.column("side"), side))
            self.nodes.append(own.column("ref").combine_chunks())
            lists.append(own.column("near").combine_chunks())
        flat = [x.flatten() for x in lists]
        codes = pa.chunked_array(flat).combine_chunks().dictionary_encode()
        self.width = max(1, len(codes.dictionary))
        number = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.number = number[: len(flat[0])]
        sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
        self.size, self.begin = sizes[0], np.cumsum(sizes[0]) - sizes[0]
        self.keys = np.sort(np.repeat(np.arange(len(sizes[1])), sizes[1]) * self.width + number[len(flat[0]) :])

    def common(self, left: pa.Array, right: pa.Array) -> np.ndarray:
        """How many numbers the lists of each pair share; each distinct pair is counted once, some at a time."""
        a, b = (pc.index_in(x, value_set=nodes).to_numpy(zero_copy_only=False).astype(np.int64) for x, nodes in ((left, self.nodes[0]), (right, self.nodes[1])))
        pairs, back = np.unique(a * len(self.nodes[1]) + b, return_inverse=True)
        a, b = pairs // len(self.nodes[1]), pairs % len(self.nodes[1])
        out, ends = np.zeros(len(a), np.int64), np.cumsum(self.size[a])
        first = 0
        while first < len(a):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 4_000_000, "right")))
            size = self.size[a[first:last]]
            owner = np.repeat(np.arange(first, last), size)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + self.begin[a[owner]]
            asked = b[owner] * self.width + self.number[place]
            found = self.keys[np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)] == asked
            out += np.bincount(owner[found], minlength=len(a))
            first = last
        return (out - (pc.equal(self.nodes[0].take(pa.array(a)), self.nodes[1].take(pa.array(b))).to_numpy(zero_copy_only=False)))[back]


def _count_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, held, lists = None, [], None
    for batch in batches:
        key = batch.column(0).to_numpy().astype(np.int64) * 2 + (batch.column(1).to_numpy() == 2)
        cuts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else []
        for begin, end in zip(cuts, [*cuts[1:], len(key)], strict=True):
            rows, own = batch.slice(begin, end - begin), int(key[begin]) // 2
            if own != part:
                part, held, lists = own, [], None
            if not key[begin] % 2:
                held.append(rows)
                continue
            if lists is None:
                lists, held = _Lists(held), []
            score = lists.common(rows.column(4), rows.column(5))
            kept = np.flatnonzero(score > 0)
            chosen = rows.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*chosen.columns[2:6], pa.array(score[kept])], names=["doc_id", "mention", "ref", "candidate", "score"])
