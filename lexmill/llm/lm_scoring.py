"""Language-model scores by a subword lattice.

A word's probability sums over every way to segment it into pieces of an
existing unigram vocabulary (a forward recursion in log space); a document's is
the product over its words and one end. The vocabulary's own scores start the
piece weights; ``PASSES`` passes of expectation over all distinct training
words fit them to the corpus. The lattice of a word also has one arc over the
whole word, whose weight is the word's training count: with N training tokens
and h words seen once, P(w) = (c(w) + h * Q(w)) / (N + h), Q being the sum over
piece paths. So what is unseen gets about the mass that Good and Turing give it.

Counts of all words stay distributed. Words with at least one in ``SHARE`` of
the training tokens are broadcast: there can't be more than ``SHARE`` of them.
All other words meet their counts in a join, pre-aggregated by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import WordCache, WordIndex, checkpointed, last_keys, split_slice, sum_by_text, text_slices, texts_of
from lexmill.llm.piece_lattice import Lattice, Vocabulary

SHARE = 1_000_000
PASSES = 2
#: Weight of the vocabulary's own scores in each pass, in uses.
PRIOR = 1000.0
HELD = 300_000  # distinct words that a task counts before it passes them on
LONGEST_BROADCAST = 64  # bytes of a word

_lattices: dict[str, Lattice] = {}


def _lattice(model_file: str) -> Lattice:
    if model_file not in _lattices:
        _lattices[model_file] = Lattice(Vocabulary.load(model_file))
    return _lattices[model_file]


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, c: how often each word occurs in all texts, A-Z lower-cased."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = WordIndex(), np.zeros(0, np.int64)

        def flushed() -> Iterator[pa.RecordBatch]:
            keys = list(index)
            for a in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([_strings(keys[a : a + 50_000]), pa.array(sums[a : min(a + 50_000, len(keys))])], names=["word", "n"])

        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                words, _ = split_slice([t.lower() for t in texts])
                at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                own = np.bincount(at, minlength=len(index))
                own[: len(sums)] += sums
                sums = own
                if len(index) > HELD:
                    yield from flushed()
                    index, sums = WordIndex(), np.zeros(0, np.int64)
        yield from flushed()

    return docs.select(F.col(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Model:
    """What is learned, but for the counts themselves."""

    model_file: str
    counts: DataFrame
    tokens: int
    distinct: int
    ends: int
    once: int
    logs: np.ndarray
    frequent: tuple[list[bytes], np.ndarray]

    @property
    def base_whole(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    @property
    def held_back(self) -> float:
        return float(max(self.once, 1))

    @property
    def end_share(self) -> float:
        return self.ends / self.tokens if self.tokens else 0.5

    @property
    def path_weight(self) -> float:
        """What the sum over piece paths is multiplied by before the count is added."""
        return self.held_back * (1 - self.end_share)

    @property
    def whole(self) -> float:
        return self.tokens + self.held_back


def _fitted(counts: DataFrame, model_file: str, logs: np.ndarray) -> np.ndarray:
    """Weights from the expected use of the pieces over all counted words, each once: paths are for new words, and new words are like other rare ones."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, use = _lattice(model_file), np.zeros(len(logs))
        for batch in batches:
            words = [b" " + w for w in texts_of(batch.column(0))]
            for a in range(0, len(words), 20_000):
                part = words[a : a + 20_000]
                use += lattice.expected(part, np.ones(len(part)), logs)
        at = np.flatnonzero(use)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(use[at])], names=["piece", "use"])

    found = counts.select("word").mapInArrow(expect, "piece int, use double").groupBy("piece").agg(F.sum("use").alias("use")).toArrow()
    use = PRIOR * np.exp(_lattice(model_file).vocabulary.logs)
    use[found["piece"].to_numpy()] += found["use"].to_numpy()
    return np.log(use / use.sum())


def train(docs: DataFrame, model_file: str, text: str = "text") -> Model:
    """Learns from every row of ``docs``; a null text is an empty one."""
    counts = checkpointed(word_counts(docs, text), "word-counts")
    ends = docs.count()
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("h")).first()
    tokens, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    often = counts.where((F.col("c") >= max(2, -(-tokens // SHARE))) & (F.octet_length("word") <= LONGEST_BROADCAST)).toArrow()
    logs = _lattice(model_file).vocabulary.logs
    if distinct > 1:
        for _ in range(PASSES):
            logs = _fitted(counts, model_file, logs)
    return Model(model_file, counts, tokens, distinct, ends, sums["h"], logs, (texts_of(often["word"]), often["c"].to_numpy()))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, n_tokens, n_known, train_tokens, base_score and score (log10) of every row; repeated rows stay apart."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.logs, model.frequent))
    model_file, base_whole, path_weight, whole = model.model_file, model.base_whole, model.path_weight, model.whole
    ends, end_share = model.ends, model.end_share
    kept = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(text).alias("t"))
    schema = rows.drop("t").schema
    for column in ("word string", "n long", "path double", "n_tokens long", "n_known long", "base double", "score double"):
        schema = schema.add(*column.split())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, (words, counts) = shared.value
        often = dict(zip(words, counts.tolist(), strict=True))
        lattice = _lattice(model_file)

        def of(new: list[bytes]) -> np.ndarray:
            """count (-1: to be joined), log10 of the paths, base and score."""
            out = np.zeros((len(new), 4))
            if new:
                out[:, 0] = [often.get(w, -1) for w in new]
                out[:, 1] = lattice.marginals([b" " + w for w in new], logs) / np.log(10)
                here = np.maximum(out[:, 0], 0)
                out[:, 2] = np.log10((here + 0.5) / base_whole)
                with np.errstate(under="ignore"):
                    out[:, 3] = np.log10((here + path_weight * 10.0 ** out[:, 1]) / whole + 1e-320)
            return out

        cache = WordCache(of, 150_000)
        seen, names = cache.index, []
        end_base, end_score = np.log10((ends + 0.5) / base_whole), np.log10(end_share)
        for batch in batches:
            for a, b, texts in text_slices(batch.column(len(kept) + 1)):
                found, sizes = split_slice([t.lower() for t in texts])
                at, table = cache.look_up(found)
                known = table[at, 0] >= 0
                owner = np.repeat(np.arange(b - a), sizes)
                sums = sum_by_text(table[at][:, 2:] * known[:, None], sizes)
                n_known = np.bincount(owner[known], minlength=b - a) + (ends > 0)
                pairs, times = np.unique((owner[~known] << 32) | at[~known], return_counts=True)
                own, word = pairs >> 32, pairs & 0xFFFFFFFF
                lacking = np.setdiff1d(np.arange(b - a), own)  # documents with nothing to join
                own, word, times = np.concatenate([own, lacking]), np.concatenate([word, np.full(len(lacking), -1)]), np.concatenate([times, np.zeros(len(lacking), np.int64)])
                leads = np.zeros(len(own), bool)
                leads[np.unique(own, return_index=True)[1]] = True  # carries what is known of the document
                numbers = batch.column(0).to_numpy()[a:b]
                if seen is not cache.index:  # the cache has begun anew
                    seen, names = cache.index, []
                names += last_keys(cache.index, len(cache.index) - len(names))
                # A name with a blank in it is no word: it finds no count, and no two documents share it.
                new, at_name = np.unique(word[word >= 0], return_inverse=True)
                labels = pa.array([names[w] for w in new.tolist()] + [b" %d" % numbers[o] for o in lacking.tolist()], pa.binary())
                take = pa.array(own + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).take(take) for i in range(len(kept) + 1)],
                        labels.take(pa.array(np.concatenate([at_name, len(new) + np.arange(len(lacking))]))).cast(pa.string()),
                        pa.array(times),
                        pa.array(np.where(word >= 0, table[np.maximum(word, 0), 1] if len(table) else 0.0, 0.0)),
                        pa.array(np.where(leads, sizes[own] + 1, 0)),
                        pa.array(np.where(leads, n_known[own], 0)),
                        pa.array(np.where(leads, sums[own, 0] + end_base, 0.0)),
                        pa.array(np.where(leads, sums[own, 1] + end_score, 0.0)),
                    ],
                    names=schema.names,
                )

    joined = rows.mapInArrow(look, schema).join(model.counts, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0)).cast("double")
    path = F.log10(F.lit(path_weight)) + F.col("path") - F.log10(F.lit(whole))
    own = F.when(c > 0, F.log10((c + F.lit(path_weight) * F.pow(F.lit(10.0), F.col("path"))) / whole)).otherwise(path)
    summed = joined.groupBy("row", *kept).agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, F.col("n")).otherwise(F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.sum(F.col("base") + F.col("n") * F.log10((c + 0.5) / base_whole)).alias("base_score"),
        F.sum(F.col("score") + F.when(F.col("n") > 0, F.col("n") * own).otherwise(F.lit(0.0))).alias("score"),
    )
    return summed.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "n_tokens", "n_known", "train_tokens", "base_score", "score")


def train_and_score(docs: DataFrame, model_file: str, learn: Column, keep: list[str], text: str = "text") -> DataFrame:
    """Learns from the rows for which ``learn`` holds and scores every row."""
    return score(docs, train(docs.where(learn), model_file, text), keep, text)
