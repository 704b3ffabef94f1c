"""The trie of all conversations: shared prefixes, their members and what storing them once saves.

A node is a distinct sequence of (role, text). It is owned by its smallest member,
so each conversation owns a suffix of its path. Of the subtree below a node, the
occurrences are the members' own suffixes and the nodes are the owned ones among
them; so tokens saved = tokens of occurrences - tokens of owned nodes, and leaves,
children and members are sums over members too. Sums along a path are windows of
one conversation; one group-by over prefixes adds them up.

A prefix is named by its length and two 64-bit sums (exclusive or) of hashes of
(place, SHA-256 of the turn): associative, so prefixes of a conversation of any
length are built in ranges of turns and put together. An accident among n nodes
has a chance of about n^2 / 2^129.

Nothing gathers a node's members or a conversation's turns: members are
aggregated with partial sums, ownership is a join on (node, conversation), turns
are dealt by sampled ranges, ids of one end node are joined to texts by ranges of
ids and only these texts meet, streamed through one hash.

Cases: a null role or text is empty, a null turn comes first, equal turn numbers
go by the digest of role and text, repeated rows are turns of their own; rows
without a conv_id belong to no conversation and are left out; a conversation
whose turns are all replaced is a member of the root alone; an empty table has no
nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm import ranges
from lexmill.llm.common import WORD, checkpointed, discard

NODE = ["depth", "a", "b"]
#: A conversation shares its head with the one whose id ends its block of so many, for so many turns less one at most.
BLOCK, HEADS = 20, 4


def digest_of(role: Column, text: Column) -> Column:
    """SHA-256 of the role, its length before it, and the text."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def _lanes(depth: Column, digest: Column) -> dict[str, Column]:
    return {"own_a": F.xxhash64(F.lit(1), depth, digest), "own_b": F.xxhash64(F.lit(2), depth, digest)}


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, digest, words, _range, i: each conversation's turns, numbered from 1."""
    narrow = conversations.where("conv_id is not null").select("conv_id", "turn", digest_of(F.col("role"), F.col("text")).alias("digest"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("words"))
    order = ["turn", "digest", "_row"]
    rows = ranges.ranged(ranges.numbered(narrow, "turns"), F.struct("conv_id", *order))
    numbered = ranges.running(rows, ["conv_id"], "_range", order, {"i": (F.lit(1), "sum")}, {"n": F.lit(1)})
    return checkpointed(numbered.select("conv_id", "digest", "words", "_range", "i", "n"), "numbered")


def shared_heads(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """conv_id, digest, words, _range, depth: the first h turns of the block's first conversation, then a conversation's own turns after its first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % block
    first = turns.where(F.col("i") < heads).select(F.col("conv_id").alias("base"), "digest", "words", "i", F.least("n", F.lit(heads)).alias("n_base")).where(F.col("base") % block == 0)
    whose = turns.where("i = 1").select("conv_id", h.alias("h"), base.alias("base"))
    taken = whose.join(first, "base").where("i <= h").select("conv_id", "digest", "words", F.lit(-1).alias("_range"), F.col("i").alias("depth"))
    lengths = whose.join(first.where("i = 1"), "base", "left").select("conv_id", "h", (F.least("h", F.coalesce("n_base", F.lit(0))) - F.col("h")).alias("shift"))
    rest = turns.join(lengths, "conv_id").where("i > h").select("conv_id", "digest", "words", "_range", (F.col("i") + F.col("shift")).alias("depth"))
    return taken.unionByName(rest)


def paths(turns: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """conv_id, depth, a, b, own_a, own_b, words, _range, length: each prefix of each conversation, the empty one included."""
    empty = conv_ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), F.lit(-1).alias("_range"), F.lit(0).cast("long").alias("own_a"), F.lit(0).cast("long").alias("own_b"), F.lit(0).alias("step"))
    own = turns.select("conv_id", F.col("depth").cast("long").alias("depth"), "words", "_range", *[v.alias(k) for k, v in _lanes(F.col("depth").cast("long"), F.col("digest")).items()], F.lit(1).alias("step"))
    both = empty.unionByName(own)
    return ranges.running(both, ["conv_id"], "_range", ["depth"], {"a": (F.col("own_a"), "xor"), "b": (F.col("own_b"), "xor")}, {"length": F.col("step")}).drop("step")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node: its texts come in order, joined by commas."""
    node, hasher = None, None

    def row() -> pa.RecordBatch:
        depth, a, b = node
        return pa.RecordBatch.from_pylist([{"depth": depth, "a": a, "b": b, "ends_sha256": hasher.hexdigest()}])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*NODE, "ids")]
        for *now, ids in zip(*columns, strict=True):
            if now == node:
                hasher.update(b",")
            else:
                if node is not None:
                    yield row()
                node, hasher = now, hashlib.sha256()
            hasher.update(ids.encode())
    if node is not None:
        yield row()


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256: of the ids that end in each node, ascending, joined by commas."""
    placed = ranges.ranged(ends, F.struct("conv_id"))
    texts = placed.groupBy(*NODE, "_range").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    sorted_texts = texts.repartition(*NODE).sortWithinPartitions(*NODE, "_range")
    return sorted_texts.select(*NODE, "ids").mapInArrow(_hashed, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row a node."""
    turns = turns_of(conversations)
    steps = checkpointed(paths(shared_heads(turns, block, heads), turns.where("i = 1").select("conv_id")), "paths")
    owners = checkpointed(steps.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.max("length").alias("deepest")), "owners")
    owned = steps.join(owners.withColumn("owned", F.lit(True)), [*NODE, "conv_id"], "left")
    marks = owned.withColumns({"owned": F.coalesce("owned", F.lit(False)), "leaf": F.coalesce((F.col("deepest") == F.col("depth")).cast("long"), F.lit(0))})
    unowned = F.when(F.col("owned"), 0).otherwise(F.col("words"))
    along = ranges.running(marks, ["conv_id"], "_range", ["depth"], {"saved_upto": (unowned, "sum"), "leaves_upto": (F.col("leaf"), "sum")}, {"saved_all": unowned, "leaves_all": F.col("leaf")})
    along = checkpointed(along.select("conv_id", *NODE, "own_a", "own_b", "owned", (F.col("saved_all") - F.col("saved_upto") + unowned).alias("saved"), (F.col("leaves_all") - F.col("leaves_upto") + F.col("leaf")).alias("leaves")), "along")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("a").bitwiseXOR(F.col("own_a")).alias("a"), F.col("b").bitwiseXOR(F.col("own_b")).alias("b")]
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    children = along.where("owned and depth > 0")
    member = along.select(*NODE, "conv_id", "saved", "leaves", one.alias("convs"), zero.alias("children"))
    child = children.select(*parent, F.lit(None).cast(steps.schema["conv_id"].dataType).alias("conv_id"), zero.alias("saved"), zero.alias("leaves"), zero.alias("convs"), one.alias("children"))
    nodes = member.unionByName(child).groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.sum("convs").alias("n_convs"), F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = children.select("conv_id", F.col("depth").alias("_depth"), *parent).join(owners.select(*NODE, F.col("conv_id").alias("parent_conv_id")), NODE).select("conv_id", F.col("_depth").alias("depth"), "parent_conv_id")
    ends = checkpointed(steps.where("depth = length").select(*NODE, "conv_id"), "ends")
    out = nodes.join(above, ["conv_id", "depth"], "left").join(ends_digests(ends), NODE, "left")
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    result = checkpointed(out, "trie")
    discard(turns, steps, owners, along, ends)
    return result
