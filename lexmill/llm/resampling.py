"""Importance resampling of documents towards a target: hashed features, weights, an exact draw in order.

1. Features are runs of words, hashed into buckets; every task adds up an array of
   counts, Spark adds the arrays.
2. The gain of a bucket compares its share of the target with its share of the
   documents, both with one count more; a document's weight is the mean gain of its
   features, looked up in the array of gains.
3. score = weight + Gumbel noise from a hash of the id: the highest scores are a
   draw without replacement by weight, the same in each run.
4. The draw. Sampled splitters cut the order (score falling, id) into ranges. Each
   task sorts its eligible rows into runs, one a range, written to the shared
   folder. A range's runs are merged by a tournament tree, which stops at the exact
   count; ranges beyond it are never read, ranges are merged at the same time.
   Counts of the ranges before give the ranks.

Cases: a null text has no features and weight 0; a null id hashes as the empty
text and comes first among ties; equal rows are drawn as rows of their own, in any
order; an empty table gives no rows, an empty target compares with equal shares;
other columns are not read. Words of any length count; texts are cut in slices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm import ranges
from lexmill.llm.common import WordIndex, checkpointed, discard, sum_by_text, text_slices

BUCKETS = 10_000
#: A-Z becomes a-z; whatever is no ASCII letter or digit and below 0x80 ends a word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words kept with their numbers in a worker: so many bytes of them at most.
_KEPT = 8_000_000


class Features:
    """Buckets of all runs of up to ``longest`` words of some texts."""

    def __init__(self, buckets: int, longest: int) -> None:
        self.buckets, self.longest = buckets, longest
        self.index, self.held, self.of = WordIndex(), 0, np.zeros(0, np.int64)

    def _numbers(self, runs: list[bytes]) -> np.ndarray:
        if self.held > _KEPT:
            self.index, self.held, self.of = WordIndex(), 0, np.zeros(0, np.int64)
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, runs), np.int64, len(runs))
        if len(self.index) > known:
            new = list(self.index)[known:]
            self.held += sum(map(len, new)) + 100 * len(new)
            self.of = np.concatenate([self.of, np.fromiter((zlib.crc32(w) % self.buckets for w in new), np.int64, len(new))])
        return self.of[at]

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all features, text by text, and how many each text has."""
        parts = [t.translate(_FOLD).split() for t in texts]
        if self.longest > 1:
            parts = [[b" ".join(p[i : i + n]) for n in range(1, self.longest + 1) for i in range(len(p) - n + 1)] for p in parts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return self._numbers([w for p in parts for w in p]), counts


def bucket_counts(docs: DataFrame, text: str, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """bucket, n: features of all texts; a task sends one count a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                total += np.bincount(features.of_texts(texts)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the ratio of shares) for each bucket, from two tables of bucket counts of at most ``buckets`` rows."""
    spark = source.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    found = both.orderBy("bucket").select("s", "t").toArrow()
    s, t = (pa.chunked_array(found[c]).to_numpy().astype(np.float64) for c in ("s", "t"))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, text: str, record_id: str, longest: int = 1) -> DataFrame:
    """id, n_features, weight: the mean gain, rounded down."""
    kind = docs.schema[record_id].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(gain), longest)
        for batch in batches:
            for begin, end, texts in text_slices(batch.column(1)):
                at, counts = features.of_texts(texts)
                total = sum_by_text(gain[at], counts).astype(np.int64)
                mean = np.where(counts > 0, total // np.maximum(counts, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(counts, pa.int64()), pa.array(mean, pa.int64())], names=["id", "n_features", "weight"])

    schema = f"id {kind.simpleString()}, n_features long, weight long"
    return docs.select(F.col(record_id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(score, schema)


def gumbel(record_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256("seed:id")."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(record_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


class Tournament:
    """The least of k sorted runs again and again: a tree of winners, of which one path is played anew after each."""

    _END = (1,)

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.runs = [*runs, *[iter(())] * (self.size - len(runs))]
        self.heads = [self._next(i) for i in range(self.size)]
        self.winner = [0] * self.size + list(range(self.size))
        for node in reversed(range(1, self.size)):
            self._play(node)

    def _next(self, run: int) -> tuple:
        found = next(self.runs[run], None)
        return self._END if found is None else (0, found)

    def _play(self, node: int) -> None:
        a, b = self.winner[2 * node], self.winner[2 * node + 1]
        self.winner[node] = b if self.heads[b] < self.heads[a] else a

    def __iter__(self) -> Iterator[tuple]:
        while True:
            run = self.winner[1] if self.size > 1 else 0
            if self.heads[run] == self._END:
                return
            yield self.heads[run][1]
            self.heads[run] = self._next(run)
            node = (run + self.size) // 2
            while node:
                self._play(node)
                node //= 2


def _to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range and batch, its keys in order: batches come sorted by range and key."""
    for batch in batches:
        of = batch.column("_range").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]]) if len(of) else np.zeros(1, np.int64)
        offsets = pa.array(cuts, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("minus", "id", "_row")]
        first = pa.array(cuts[:-1])
        yield pa.RecordBatch.from_arrays([batch.column(c).take(first) for c in ("_range", "before", "quota")] + lists, names=["_range", "before", "quota", "minus", "id", "_row"])


def _merged(group: pa.Table) -> pa.Table:
    """_row, rank: the first ``quota`` of a range's runs, numbered on from those before."""

    def run(i: int) -> Iterator[tuple]:
        minus, ids, rows = (group[c][i].values for c in ("minus", "id", "_row"))
        for j in range(len(rows)):
            named = ids[j].as_py()
            yield minus[j].as_py(), named is not None, 0 if named is None else named, rows[j].as_py()

    before, quota = group["before"][0].as_py(), group["quota"][0].as_py()
    drawn = [row for (*_, row), _ in zip(Tournament([run(i) for i in range(len(group))]), range(quota), strict=False)]
    return pa.table({"_row": pa.array(drawn, pa.int64()), "rank": pa.array(range(before + 1, before + len(drawn) + 1), pa.int64())})


def draw(scored: DataFrame, eligible: Column, percent: int, each: int = ranges.EACH) -> DataFrame:
    """_row, rank: the exact number of eligible rows with the highest scores, ties to smaller ids. ``scored``: a table with id, score, _row."""
    able = scored.where(eligible).select("id", (-F.col("score")).alias("minus"), "_row")
    key = F.struct("minus", "id", "_row")
    placed = checkpointed(ranges.ranged(able, key, each=each), "placed")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    listed = checkpointed(ranges.running(sizes, [], "_range", ["_range"], {"upto": (F.col("n"), "sum")}, {"n_able": F.col("n")}), "sizes")
    wanted = F.floor(F.col("n_able") * F.lit(percent) / 100).cast("long")
    before = F.col("upto") - F.col("n")
    quotas = listed.select("_range", before.alias("before"), F.least(F.col("n"), wanted - before).alias("quota")).where("quota > 0")
    kind = scored.schema["id"].dataType.simpleString()
    schema = f"_range int, before long, quota long, minus array<long>, id array<{kind}>, _row array<long>"
    mine = placed.join(F.broadcast(quotas), "_range").select("_range", "before", "quota", "minus", "id", "_row")
    runs = checkpointed(mine.sortWithinPartitions("_range", "minus", "id", "_row").mapInArrow(_to_runs, schema), "runs")
    ranks = checkpointed(runs.groupBy("_range").applyInArrow(_merged, "_row long, rank long"), "ranks")
    discard(placed, runs)
    return ranks


def resample(docs: DataFrame, target: DataFrame, seed: int, percent: int, least_features: int = 20, text: str = "text", record_id: str = "doc_id", buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """id, n_features, weight, score, rank: of all documents; rank null where not drawn."""
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, text, buckets, longest), buckets)
    made = weights(docs, gain, text, record_id, longest)
    scored = ranges.numbered(made.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "scored")
    ranks = draw(scored, F.col("n_features") >= least_features, percent)
    return scored.join(ranks, "_row", "left").select("id", "n_features", "weight", "score", "rank")
