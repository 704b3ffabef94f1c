"""Near-duplicate join on word n-grams by a MinHash LSH forest, with exact verification.

A document is its set of ``n`` consecutive words (one n-gram of all words, if it
has fewer); documents with equal sets collapse into one representative with a
count. A representative's signature gives one label per tree, ``DEEPEST`` MinHash
values long; a tree's sorted labels are its prefix trie. Trie nodes are walked
from the whole label upwards: a prefix is shortened value by value, and at each
length only those members are compared that no longer prefix has connected. A
node is shortened until all below it are connected, or until the length at which
a pair at the threshold shares a prefix in some tree with a chance of ``RECALL``
(``prefix_depth``).

Members of a node are compared by their whole signatures; pairs whose agreement
is not below ``threshold - SLACK`` connect them. Each connected candidate group
is then verified exactly, all its pairs by their n-grams, also those that shared
no prefix. Nodes and groups of more than a block, by members or by bytes of text,
are dealt as pairs of blocks, so no task holds a large group and a text is sent
once a block of its group; a task returns link counts and spanning edges, never
all pairs. Links and classes count every copy.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm.common import WordCache, checkpointed, discard, mix64, split_slice, text_slices
from lexmill.llm.components import components
from lexmill.llm.substring_dedup import window_hashes, word_hashes

WORDS = 5
THRESHOLD = 0.8
TREES = 20
DEEPEST = 8
RECALL = 0.9999
SLACK = 0.22
NODE_BLOCK = 1024
GROUP_BLOCK = 768
GROUP_BYTES = 6_000_000


def prefix_depth(trees: int = TREES, deepest: int = DEEPEST, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The length to which prefixes are shortened at most: the longest at which a pair at the threshold is met with this chance."""
    for depth in range(deepest, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(0, 1 << 63, TREES * DEEPEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, TREES * DEEPEST, dtype=np.uint64)


def signature(grams: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value."""
    least = np.full(len(_FACTORS), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for a in range(0, len(grams), 4096):
            np.minimum(least, (grams[a : a + 4096, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return (mix64(least) & np.uint64(0xFFFF)).astype("<u2")


def gram_sets(texts: list[bytes], cache: WordCache, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; empty for a text without words."""
    words, counts = split_slice(texts)
    if not words:
        return [np.zeros(0, np.uint64)] * len(texts)
    at, table = cache.look_up(words)
    hashes, owner, _ = window_hashes(table[at], counts, n)
    ends = np.cumsum(np.maximum(counts - n + 1, 0))
    sets = [np.unique(x) for x in np.split(hashes, ends[:-1])]
    first = np.cumsum(counts) - counts
    for i in np.flatnonzero((counts > 0) & (counts < n)).tolist():
        own = b" ".join(words[first[i] : first[i] + counts[i]])
        sets[i] = np.array([xxhash.xxh3_64_intdigest(own, 1)], np.uint64)
    return sets


def _signed(docs: DataFrame, text: str, key: str, n: int) -> DataFrame:
    """id, mark (a hash of the text), bytes, f1 and f2 (a fingerprint of the n-gram set), sig; without documents that have no word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(word_hashes)
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, texts in text_slices(batch.column(2)):
                rows = []
                for own, mark, value, grams in zip(ids[a:b], marks[a:b], texts, gram_sets(texts, cache, n), strict=True):
                    if len(grams):
                        digest = xxhash.xxh3_128_digest(grams.tobytes())
                        rows.append((own, mark, len(value), *np.frombuffer(digest, "<i8").tolist(), signature(grams).tobytes()))
                if rows:
                    kinds = (*[pa.int64()] * 5, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "mark", "bytes", "f1", "f2", "sig"])

    known = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long"), F.xxhash64(F.col(text)), F.col(text))
    return known.mapInArrow(sign, "id long, mark long, bytes long, f1 long, f2 long, sig binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of the first column, sorted by it, with the runs' first rows; runs may cross batches."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        keys = table.column(0).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and keys[0] != held[-1].column(0)[-1].as_py():
            cuts = np.concatenate([[0], cuts])
        if not len(cuts):
            held.append(table)
            continue
        whole = pa.concat_tables([*held, table.slice(0, int(cuts[-1]))])
        held = [table.slice(int(cuts[-1]))]
        if len(whole):
            keys = whole.column(0).to_numpy()
            yield whole, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    if held:
        whole = pa.concat_tables(held)
        keys = whole.column(0).to_numpy()
        yield whole, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges of a symmetric matrix of flags."""
    edges, left = [], set(range(len(near)))
    while left:
        stack = [min(left)]
        left.discard(stack[0])
        while stack:
            at = stack.pop()
            found = [i for i in np.flatnonzero(near[at]).tolist() if i in left]
            left.difference_update(found)
            edges += [(at, i) for i in found]
            stack += found
    return edges


def walk(labels: np.ndarray, sigs: np.ndarray, own: np.ndarray, depth: int, least: int) -> list[tuple[int, int]]:
    """Spanning edges of one trie node: rows that share ``depth`` values of their labels.

    Longer prefixes first; rows of one block (``own`` is not negative) are not
    compared with each other.
    """
    n, most = labels.shape
    order = np.lexsort(labels.T[::-1])
    labels, sigs, own = labels[order], sigs[order], own[order]
    differs = labels[1:] != labels[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), most)  # values that a row shares with the one before
    root, below, edges = np.arange(n), np.arange(n), []
    for length in range(most, depth - 1, -1):
        node = np.concatenate([[0], np.cumsum(shared < length)])
        for a, b in zip(begins := np.flatnonzero(np.diff(node, prepend=-1)), np.append(begins[1:], n), strict=True):
            if b - a < 2 or (root[a:b] == root[a]).all():
                continue
            for i in range(a, b - 1):
                # Rows below one longer prefix have met before.
                others = i + 1 + np.flatnonzero((root[i + 1 : b] != root[i]) & (below[i + 1 : b] != below[i]) & ((own[i] < 0) | (own[i + 1 : b] != own[i])))
                if len(others):
                    for j in others[(sigs[others] == sigs[i]).sum(axis=1) >= least].tolist():
                        if root[j] != root[i]:
                            edges.append((int(order[i]), int(order[j])))
                            root[root == root[j]] = root[i]
        below = node
    return edges


def _blocks(rows: DataFrame, group: str, parts: Column, member: str) -> DataFrame:
    """Adds part (a key of the task's rows) and own (the row's block of two, or -1 within one): groups of several parts as pairs of blocks."""
    own = F.pmod(F.xxhash64(member), F.col("__parts")).cast("int")
    dealt = rows.withColumn("__parts", F.greatest(F.lit(1), parts).cast("int")).withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    return dealt.withColumn("part", F.xxhash64(F.col(group), low, high)).withColumn("own", F.when(low == high, F.lit(-1)).otherwise(F.when(F.col("__own") == low, F.lit(0)).otherwise(F.lit(1)))).drop("__parts", "__own", "__other")


def _by_part(rows: DataFrame, columns: list[str], make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return rows.select(*columns).repartition("part").sortWithinPartitions(*columns[:2]).mapInArrow(make, schema)


def candidate_edges(reps: DataFrame, threshold: float) -> DataFrame:
    """a, b: representatives that share a trie node and have similar signatures; spanning edges only."""
    depth = prefix_depth(threshold=threshold)
    least = math.ceil((threshold - SLACK) * TREES * DEEPEST)

    def label(tree: Column) -> Column:
        return F.xxhash64(tree, F.substr("sig", tree * F.lit(2 * DEEPEST) + F.lit(1), F.lit(2 * depth)))

    leaves = reps.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("rep", "tree", label(F.col("tree")).alias("node"))
    nodes = leaves.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = leaves.join(nodes, "node").join(reps.select("rep", "sig"), "rep")
    dealt = _blocks(shared, "node", F.ceil(F.col("size") / NODE_BLOCK), "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _runs(batches):
            reps, own, tree = (table.column(i).to_numpy() for i in (1, 2, 3))
            sigs = np.frombuffer(b"".join(table.column(4).to_pylist()), "<u2").reshape(len(reps), -1)
            ends = np.append(begins[1:], len(reps))
            edges = []
            two = np.flatnonzero(ends - begins == 2)
            first = begins[two]
            fine = first[((sigs[first] == sigs[first + 1]).sum(axis=1) >= least) & ((own[first] < 0) | (own[first] != own[first + 1]))]
            edges.append(np.column_stack([reps[fine], reps[fine + 1]]))
            for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                if b - a > 2:
                    labels = sigs[a:b, DEEPEST * tree[a] : DEEPEST * (tree[a] + 1)]
                    edges.append(reps[a + np.array(walk(labels, sigs[a:b], own[a:b], depth, least), np.int64).reshape(-1, 2)])
            found = np.concatenate(edges)
            if len(found):
                found = np.unique(np.column_stack([found.max(axis=1), found.min(axis=1)]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return _by_part(dealt, ["part", "rep", "own", "tree", "sig"], compare, "a long, b long").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[number] > 1
    owner, number = owner[shared], number[shared]
    _, number = np.unique(number, return_inverse=True)
    out = np.zeros((n, n), np.float32)
    step = max(256, 4_000_000 // n)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        lo, hi = np.searchsorted(number, [a, a + step])
        part = np.zeros((n, step), np.float32)
        part[owner[lo:hi], number[lo:hi] - a] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _verify(groups: DataFrame, threshold: float, n: int) -> DataFrame:
    """rep, mark, links (from this task's pairs), and an edge to another representative, if there is one."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(word_hashes)
        for table, begins in _runs(batches):
            reps, own, copies, marks = (table.column(i).to_numpy() for i in (1, 2, 3, 4))
            texts = table.column(5).combine_chunks()
            ends = np.append(begins[1:], len(reps))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                sets: list[np.ndarray] = []
                for _, _, own_texts in text_slices(texts.slice(a, b - a)):
                    sets += gram_sets(own_texts, cache, n)
                sizes = np.array([len(s) for s in sets])
                both = overlaps(sets)
                near = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
                near &= ((own[a:b, None] < 0) | (own[a:b, None] != own[None, a:b])) & (sizes[:, None] > 0)
                np.fill_diagonal(near, False)
                to = np.full(b - a, -1)
                for x, y in _forest(near):
                    to[y] = x
                out.append((reps[a:b], marks[a:b], near @ copies[a:b], np.where(to < 0, reps[a:b], reps[a + np.maximum(to, 0)])))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "mark", "links", "other"])

    return _by_part(groups, ["part", "rep", "own", "copies", "mark", "text"], verify, "rep long, mark long, links long, other long")


def link(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id", n: int = WORDS) -> DataFrame:
    """doc_id, class_id, n_links, one row for each row of ``docs``.

    class_id: the smallest id of the documents connected by links; n_links: how
    many other rows have a Jaccard similarity of at least ``threshold``. Rows
    without a word are classes of their own, rows without an id have none;
    rows that share an id share a class.
    """
    signed = checkpointed(_signed(docs, text, key, n), "signatures")
    # Of equal sets the row with the smallest id speaks; all have the same signature.
    reps = signed.groupBy("f1", "f2").agg(F.min(F.struct("id", "mark", "bytes")).alias("m"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    reps = checkpointed(reps.select("f1", "f2", F.col("m.id").alias("rep"), F.col("m.mark").alias("mark"), F.col("m.bytes").alias("bytes"), "copies", "sig"), "representatives")
    ids = checkpointed(signed.select("id", "f1", "f2"), "members")
    discard(signed)
    candidates = components(candidate_edges(reps, threshold))
    whole, reps = reps, checkpointed(reps.drop("sig"), "representatives")
    discard(whole)
    members = candidates.join(reps.select("rep", "mark", "bytes", "copies"), F.col("node") == F.col("rep")).select("rep", "mark", "label", "bytes", "copies")
    sizes = members.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK), F.ceil(F.sum("bytes") / GROUP_BYTES)).alias("parts"))
    members = members.join(sizes, "label").drop("bytes")
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rep"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    asked = texts.join(members, ["rep", "mark"]).dropDuplicates(["rep", "mark"])  # repeated rows: copies has counted them
    found = checkpointed(_verify(_blocks(asked, "label", F.col("parts"), "rep"), threshold, n), "links")
    classes = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("rep", "mark").agg(F.sum("links").alias("links"))
    known = reps.select("f1", "f2", "rep", "mark", "copies").join(links, ["rep", "mark"], "left").join(classes.select(F.col("node").alias("rep"), "label"), "rep", "left")
    known = known.select("f1", "f2", F.coalesce("label", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    worded = ids.join(known, ["f1", "f2"]).select(F.col("id").alias(key), "class_id", "n_links")
    wordless = docs.where(F.col(key).isNull() | F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return worded.unionByName(wordless.select(F.col(key).cast("long").alias(key), F.col(key).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **options: object) -> DataFrame:
    """Of each class the document with the smallest id, with its columns; rows without an id stay."""
    leaders = link(docs, text=text, key=key, **options).where(F.col(key) == F.col("class_id")).select(F.col(key).alias("__leader")).distinct()
    first = F.row_number().over(Window.partitionBy("__leader").orderBy(text))
    kept = docs.join(leaders, F.col(key).cast("long") == F.col("__leader")).withColumn("__first", first).where("__first = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(docs.where(F.col(key).isNull()))
