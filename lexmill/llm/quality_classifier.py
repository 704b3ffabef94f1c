"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

A word's index vector is sparse and ternary, drawn from a hash of the word; its
context vector is the sum of the index vectors of the words around it in the
training sample (random indexing). Words outside the vocabulary, which is the
``VOCABULARY`` most frequent words of the sample that ``LEAST`` of its documents
have, use the vector of their form: letter case, length, symbols, digits. A document is
the mean of its words' index and context vectors, with the lengths of these means
(large if few words make up the text) and the log of its word count. A network
with one hidden layer is trained in numpy; a temperature, fitted on rows held out
of its training, calibrates its probabilities.

Training uses about ``SAMPLE`` labelled documents, half of each label if there
are as many (a documented bound, chosen by a hash of the id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import WordCache, WordIndex, split_slice, text_slices, words_of

SAMPLE = 6000
VOCABULARY, LEAST = 20_000, 3
DIMENSIONS, ONES = 32, 4
NEAR = 2  # words on either side that count as context
HIDDEN, EPOCHS, RATE, DECAY = 32, 300, 0.01, 1e-4
FEATURES = 2 * DIMENSIONS + 3


def index_vectors(words: list[bytes]) -> np.ndarray:
    """Sparse ternary vectors of unit length."""
    seeds = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros((len(words), DIMENSIONS), np.float32)
    rows = np.arange(len(words))
    for i in range(ONES):
        part = (seeds >> np.uint64(16 * i)).astype(np.int64) & 0xFFFF
        out[rows, part % DIMENSIONS] += np.where(part >> 15, 1, -1) / np.sqrt(ONES)
    return out


_PUNCTUATION = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()", np.uint8))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>{}[]=_~^\\/@", np.uint8))
_MOST_SYMBOLS, _MOST_SIZE = 4, 6
#: Numbers of forms: letter case, digits, end, symbols, length.
FORMS = 3 * 2 * 2 * (_MOST_SYMBOLS + 1) * (_MOST_SIZE + 1)


def forms(words: list[bytes]) -> np.ndarray:
    """What words look like, as a number below FORMS: letter case, digits, marks at the end, symbols, length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(begin, sizes)

    def some(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.int64), begin)

    upper, lower = (flat >= 65) & (flat <= 90), (flat >= 97) & (flat <= 122)
    inner = ~_PUNCTUATION[flat]
    first = np.minimum.reduceat(np.where(inner, place, len(flat)), begin)
    last = np.maximum.reduceat(np.where(inner, place, -1), begin)
    led = (last >= 0) & upper[begin + np.minimum(first, sizes - 1)]
    whole = (some(upper) > 0) & (some(lower) == 0) & (last > first)
    kind = np.where(whole, 2, np.where(led, 1, 0))
    digits = some((flat >= 48) & (flat < 58)) > 0
    end = np.isin(flat[begin + sizes - 1], np.frombuffer(b"!?", np.uint8))
    symbols = np.minimum(some(_SYMBOL[flat]), _MOST_SYMBOLS)
    return (((kind * 2 + digits) * 2 + end) * (_MOST_SYMBOLS + 1) + symbols) * (_MOST_SIZE + 1) + np.minimum(sizes // 4, _MOST_SIZE)


@dataclass
class Contexts:
    """Context vectors of words, and of forms (a row each) for words that have none."""

    words: dict[bytes, int]
    vectors: np.ndarray
    forms: np.ndarray

    def of(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        return np.where(at[:, None] >= 0, self.vectors[at], self.forms[forms(words)])


@dataclass
class Classifier:
    contexts: Contexts
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def vectors(self, words: list[bytes]) -> np.ndarray:
        return word_vectors(words, self.contexts)

    def probability(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((features - self.mean) / self.scale) @ self.first + self.first_bias)
        margin = (hidden @ self.second + self.second_bias) / self.temperature
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def word_vectors(words: list[bytes], contexts: Contexts) -> np.ndarray:
    if not words:
        return np.zeros((0, 2 * DIMENSIONS), np.float32)
    return np.concatenate([index_vectors(words), contexts.of(words)], axis=1)


def pooled(texts: list[bytes], cache: WordCache) -> np.ndarray:
    """Features of each text; all zeros for one without words."""
    words, counts = split_slice(texts)
    if not words:
        return np.zeros((len(texts), FEATURES))
    at, table = cache.look_up(words)
    mean = np.zeros((len(texts), 2 * DIMENSIONS))
    some = np.flatnonzero(counts)
    begin = (np.cumsum(counts) - counts)[some]
    mean[some] = np.add.reduceat(table[at], begin, axis=0, dtype=np.float64) / counts[some, None]
    sizes = [np.log(1e-4 + (mean[:, d : d + DIMENSIONS] ** 2).sum(axis=1)) for d in (0, DIMENSIONS)]
    return np.where(counts[:, None] > 0, np.column_stack([mean, *sizes, np.log1p(counts)]), 0)


def _contexts(sample: DataFrame, vocabulary: list[bytes]) -> Contexts:
    """Context vectors of the vocabulary and of forms, of unit length; a form that was never seen has none."""
    n_words = len(vocabulary)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {w: i for i, w in enumerate(vocabulary)}
        sums = np.zeros((n_words + FORMS, DIMENSIONS))
        for batch in batches:
            for a, b, texts in text_slices(batch.column(0)):
                words, counts = split_slice(texts)
                if not words:
                    continue
                index = WordIndex()
                at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                distinct = list(index)
                own, owner = index_vectors(distinct)[at], np.repeat(np.arange(b - a), counts)
                around = np.zeros_like(own)
                for step in range(1, NEAR + 1):
                    same = (owner[step:] == owner[:-step])[:, None]
                    around[step:] += own[:-step] * same
                    around[:-step] += own[step:] * same
                order = np.argsort(at, kind="stable")
                totals = np.add.reduceat(around[order], np.searchsorted(at[order], np.arange(len(distinct))), axis=0, dtype=np.float64)
                known = np.fromiter((names.get(w, -1) for w in distinct), np.int64, len(distinct))
                sums[known[known >= 0]] += totals[known >= 0]
                np.add.at(sums, n_words + forms(distinct), totals)
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([v.astype("<f8").tobytes() for v in sums[some]], pa.binary())], names=["at", "v"])

    table = sample.select("t").mapInArrow(gather, "at long, v binary").toArrow().sort_by([("at", "ascending"), ("v", "ascending")])
    sums = np.zeros((n_words + FORMS, DIMENSIONS))
    np.add.at(sums, table["at"].to_numpy(), np.frombuffer(b"".join(table["v"].to_pylist()), "<f8").reshape(-1, DIMENSIONS))
    unit = (sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-9)).astype(np.float32)
    return Contexts({w: i for i, w in enumerate(vocabulary)}, unit[: max(n_words, 1)], unit[n_words:])


def _fit(features: np.ndarray, labels: np.ndarray, contexts: Contexts) -> Classifier:
    """Adam over all rows but every fifth, on which the temperature is fitted."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x, y = (features - mean) / scale, labels.astype(np.float64)
    held = np.arange(len(y)) % 5 == 4
    if held.all() or len(np.unique(y[~held])) < 2:
        held[:] = False
    random = np.random.default_rng(7)
    weights = [random.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    train_x, train_y = x[~held], y[~held]
    for step in range(1, EPOCHS + 1):
        hidden = np.tanh(train_x @ weights[0] + weights[1])
        p = 1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -500, 500)))
        error = (p - train_y) / len(train_y)
        back = np.outer(error, weights[2]) * (1 - hidden**2)
        slopes = [train_x.T @ back + DECAY * weights[0], back.sum(axis=0), hidden.T @ error + DECAY * weights[2], error.sum(keepdims=True)]
        for i, slope in enumerate(slopes):
            m, v = moments[i]
            m += 0.1 * (slope - m)
            v += 0.001 * (slope**2 - v)
            weights[i] = weights[i] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    temperature = 1.0
    if held.any():
        margin = np.tanh(x[held] @ weights[0] + weights[1]) @ weights[2] + weights[3]
        loss = lambda t: np.logaddexp(0, np.where(y[held] > 0, -margin, margin) / t).mean()
        temperature = min((float(t) for t in np.geomspace(0.2, 10, 60)), key=loss)
    return Classifier(contexts, mean, scale, weights[0], weights[1], weights[2], float(weights[3][0]), temperature)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", sample: int = SAMPLE) -> Classifier | float:
    """A classifier from documents with label 0 or 1 (others and nulls are left out); with one label only that label, with none 0.5.

    Of a document with both labels the lower counts. Ids and labels are joined
    without texts; the ids of the sample, a bounded list, then fetch its texts.
    """
    marked = labels.select(F.col(key).cast("string").alias("k"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").groupBy("k").agg(F.min("y").alias("y"))
    pairs = docs.select(F.col(key).cast("string").alias("k")).distinct().join(marked, "k")
    sizes = {r["y"]: r["n"] for r in pairs.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes), 0.5))
    share = F.when(F.col("y") == 1, min(1_000_000, sample // 2 * 1_000_000 // sizes[1] + 1)).otherwise(min(1_000_000, sample // 2 * 1_000_000 // sizes[0] + 1))
    taken = pairs.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < share).orderBy("k").collect()
    spark = docs.sparkSession
    keys = F.broadcast(spark.createDataFrame([(r["k"], r["y"]) for r in taken], "k string, y int"))
    chosen = docs.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(keys, "k").repartition(8).persist()
    counted = chosen.select(F.explode(F.array_distinct(words_of(F.col("t")))).alias("w")).where(F.octet_length("w") <= 64).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    vocabulary = [r["w"].encode() for r in counted.orderBy(F.col("n").desc(), "w").limit(VOCABULARY).collect()]
    contexts = _contexts(chosen, vocabulary)
    shared = spark.sparkContext.broadcast(contexts)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(lambda words: word_vectors(words, shared.value), 100_000)
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                rows = pooled(texts, cache)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.astype("<f8").tobytes() for r in rows], pa.binary()), batch.column(2).slice(a, b - a)], names=["k", "v", "y"])

    table = chosen.mapInArrow(pool, "k string, v binary, y int").toArrow().sort_by([("k", "ascending"), ("v", "ascending")])
    chosen.unpersist()
    features = np.frombuffer(b"".join(table["v"].to_pylist()), "<f8").reshape(-1, FEATURES)
    order = np.random.default_rng(3).permutation(len(features))
    labels = table["y"].to_numpy()[order]
    if len(np.unique(labels)) < 2:
        return float(labels[0]) if len(labels) else 0.5
    return _fit(features[order], labels, contexts)


def score(docs: DataFrame, model: Classifier | float, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, score (probability of label 1; empty and null texts too) and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("score", "double").add("predicted", "integer")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = None if isinstance(model, float) else WordCache(model.vectors, 100_000)
        for batch in batches:
            out = np.full(batch.num_rows, model if isinstance(model, float) else 0.5)
            for a, b, texts in text_slices(batch.column(len(keep))) if cache else ():
                out[a:b] = model.probability(pooled(texts, cache))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text")).mapInArrow(judge, schema)


def train_and_score(docs: DataFrame, labels: DataFrame, learn: Column, keep: list[str], text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Learns from the labelled rows of ``docs`` for which ``learn`` holds; scores every row."""
    return score(docs, train(docs.where(learn), labels, text, label, key), keep, text)
