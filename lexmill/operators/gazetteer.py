"""Greedy dictionary matching over token arrays.

At each start the longest prefix that any name shares is walked; the start
matches only if that whole prefix is itself a name (there is no way back to a
shorter one). Matches are taken from the left and don't overlap.

Only tokens that begin some name are tried: words meet the table of first words
(with the longest name that each begins), a document gets its starts back, and a
start carries as many words as its own longest name has. Prefixes meet the table
of prefixes in an equi-join on text; the overlap rule is one sweep over a
document's hits in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def _text(words: object, n: object) -> object:
    return F.array_join(F.slice(words, 1, n), SEPARATOR)


def hits(docs: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, b, n, name: every start whose longest shared prefix is a name. docs: doc_id, words; names: name (words)."""
    known = names.select("name").distinct().where(F.size("name") > 0)
    prefixes = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("name")), lambda i: F.struct(_text(F.col("name"), i).alias("prefix"), i.alias("n")))).alias("p")).select("p.prefix", "p.n").distinct()
    firsts = known.groupBy(F.col("name")[0].alias("first")).agg(F.max(F.size("name")).alias("longest"))
    placed = docs.select("doc_id", F.posexplode("words").alias("b", "first")).join(firsts, "first")
    starts = placed.groupBy("doc_id").agg(F.collect_list(F.struct("b", "longest")).alias("starts"))
    tried = docs.join(starts, "doc_id").select("doc_id", "words", F.explode("starts").alias("s"))
    tried = tried.select("doc_id", "s.b", F.slice("words", F.col("s.b") + 1, F.col("s.longest")).alias("ahead"))
    tried = tried.select("doc_id", "b", F.explode(F.transform(F.sequence(F.lit(1), F.size("ahead")), lambda i: F.struct(_text(F.col("ahead"), i).alias("prefix"), i.alias("n")))).alias("p")).select("doc_id", "b", "p.prefix", "p.n")
    walked = tried.join(prefixes, ["prefix", "n"]).groupBy("doc_id", "b").agg(F.max(F.struct("n", "prefix")).alias("w")).select("doc_id", "b", "w.n", "w.prefix")
    whole = known.select(_text(F.col("name"), F.size("name")).alias("prefix"), F.col("name"))
    return walked.join(whole, "prefix").select("doc_id", F.col("b").cast("long").alias("b"), "n", "name")


def leftmost(found: DataFrame) -> DataFrame:
    """doc_id, b, e, name: of the hits, from the left, those that start where the last one taken has ended."""
    schema = found.select("doc_id", "b", (F.col("b") + F.col("n")).alias("e"), "name").schema
    lists = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("b", (F.col("b") + F.col("n")).alias("e"), "name"))).alias("hits"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(1)
            rows = hits.flatten()
            b, e = (rows.field(n).to_pylist() for n in ("b", "e"))
            owners, taken, at = [], [], 0
            for owner, size in enumerate(hits.value_lengths().to_pylist()):
                end = 0
                for i in range(at, at + size):
                    if b[i] >= end:
                        owners.append(owner)
                        taken.append(i)
                        end = e[i]
                at += size
            rows = rows.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *(rows.field(n) for n in ("b", "e", "name"))], names=["doc_id", "b", "e", "name"])

    return lists.mapInArrow(sweep, schema)


def annotate(docs: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, b, e, name: greedy, leftmost, non-overlapping matches."""
    return leftmost(hits(docs, names))


def annotate_items(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc_id, b, e, uids: matches with the ids of all items of that name. aliases: qid, name (words)."""
    ids = aliases.groupBy("name").agg(F.array_sort(F.collect_set("qid")).alias("uids"))
    return annotate(docs, aliases).join(ids, "name").select("doc_id", "b", "e", "uids")
