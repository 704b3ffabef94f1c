"""Language identification by prediction by partial matching.

Per language, a tree of byte contexts up to ``order`` bytes holds symbol
counts. A byte costs ``-log2`` of its probability in the longest known context;
an unseen symbol pays the escape (method C: as many escapes as distinct
symbols) and is coded one context shorter, with the symbols of the longer
context excluded. Statistics are frozen after training, so a code length is a
function of the word alone: contexts start at the blank before a word, every
word is followed by a blank, and the text's length is the exact sum over its
words. The language with the shortest code wins; the score is its posterior
under equal priors.

Training uses about ``docs_per_lang`` labelled documents of each language (a
documented bound; fewer if there are fewer), chosen by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import WordCache, split_slice, sum_by_text, text_slices, texts_of, words_of

ORDER = 4
DOCS_PER_LANG = 1000
UNKNOWN = "und"
#: Distinct words of the sample that are counted at a time, and symbols that are coded at a time.
CHUNK = 40_000
#: Bytes of the code lengths that a task remembers.
MEMORY = 24_000_000


def _stream(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of blank-separated words with a blank at both ends, and for each byte its distance from the blank before its word."""
    flat = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    at = np.arange(len(flat))
    blank = np.where(flat == 32, at, 0)
    start = np.zeros(len(flat), np.int64)
    start[1:] = np.maximum.accumulate(blank)[:-1]
    return flat, at - start


@dataclass
class Level:
    """Contexts of one length. grams: context and symbol, sorted; the other arrays have a column per language."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    excluded: np.ndarray  # count, one context shorter, of the symbols seen here


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.zeros((len(keys), parts[0][1].shape[1]))
    np.add.at(counts, inverse, np.concatenate([p[1] for p in parts]))
    return keys, counts


def _gram_counts(words: list[bytes] | pa.ChunkedArray, lang: np.ndarray, weight: np.ndarray, n_langs: int, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k = 0..order, the grams of k + 1 bytes and their counts in each language; so many words at a time, to bound memory."""
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
    for a in range(0, max(len(words), 1), CHUNK):
        part = words[a : a + CHUNK]
        part = part if isinstance(part, list) else texts_of(part)
        own_lang, own_weight = lang[a : a + CHUNK], weight[a : a + CHUNK]
        flat, age = _stream(part)
        owner = np.cumsum(np.concatenate([[0], (flat[:-1] == 32).astype(np.int64)])) - 1
        grams = flat.copy()
        for k in range(order + 1):
            if k:  # each byte with the k bytes before it, oldest in the highest bits
                grams[k:] |= flat[:-k] << np.uint64(8 * k)
            at = np.flatnonzero((age >= max(k, 1)) & (owner < len(part)))
            keys, inverse = np.unique(grams[at], return_inverse=True)
            which = owner[at]
            counts = np.bincount(inverse * n_langs + own_lang[which], weights=own_weight[which], minlength=len(keys) * n_langs).reshape(len(keys), n_langs)
            levels[k].append((keys, counts))
            if len(levels[k]) >= 8:
                levels[k] = [_merged(levels[k])]
    return [_merged(parts) for parts in levels]


class _Memo:
    """Code lengths of symbols by open addressing, at most half full."""

    _FACTOR, _NONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, n_langs: int) -> None:
        bits = max(10, (MEMORY // (8 * n_langs + 8)).bit_length() - 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.cost = np.full(1 << bits, self._NONE), np.zeros((1 << bits, n_langs))
        self.n = 0

    def room(self, n: int) -> bool:
        return 2 * (self.n + n) <= len(self.keys)

    def clear(self) -> None:
        self.keys[:], self.n = self._NONE, 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * self._FACTOR) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at = self._slot(keys)
        left = np.flatnonzero(self.keys[at] != keys)
        while len(left):
            none = self.keys[at[left]] == self._NONE
            at[left[none]] = -1
            left = left[~none]
            at[left] = (at[left] + 1) & self.mask
            left = left[self.keys[at[left]] != keys[left]]
        return at

    def add(self, keys: np.ndarray, cost: np.ndarray) -> None:
        """Takes in distinct keys that are not there yet."""
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == self._NONE)
            place, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.keys[place], self.cost[place] = keys[left[taken]], cost[left[taken]]
            rest = np.ones(len(left), bool)
            rest[taken] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask
        self.n += len(keys)


class ContextTrees:
    """The trees of all languages over one union of contexts."""

    def __init__(self, words: list[bytes] | pa.ChunkedArray, lang: np.ndarray, weight: np.ndarray, langs: list[str], order: int = ORDER) -> None:
        self.langs, self.order, self.levels = langs, order, []
        for k, (keys, counts) in enumerate(_gram_counts(words, lang, weight, len(langs), order)):
            contexts, node = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.zeros((len(contexts), len(langs)))
            distinct, excluded = total.copy(), total.copy()
            np.add.at(total, node, counts)
            np.add.at(distinct, node, counts > 0)
            if k:
                shorter = self.levels[-1]
                row = np.searchsorted(shorter.grams, keys & np.uint64((1 << (8 * k)) - 1))
                np.add.at(excluded, node, np.where(counts > 0, shorter.counts[row], 0))
            self.levels.append(Level(keys, counts, contexts, total, distinct, excluded))
        for level in self.levels:  # counts are whole numbers
            level.counts, level.total, level.distinct, level.excluded = (x.astype(np.uint32) for x in (level.counts, level.total, level.distinct, level.excluded))

    def bits(self, words: list[bytes]) -> np.ndarray:
        """Code length of each word, with the blank after it, in each language."""
        if not words:
            return np.zeros((0, len(self.langs)))
        flat, age = _stream(words)
        keys = flat.copy()
        for k in range(1, self.order + 1):
            keys[k:] |= np.where(age[k:] >= k, flat[:-k], np.uint64(0)) << np.uint64(8 * k)
        ends = np.flatnonzero(flat == 32)
        at, cost = self._known(keys[1:])
        return np.add.reduceat(cost[at], ends[:-1], axis=0)

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each symbol with its context, table of code lengths); what is new is remembered as far as MEMORY goes."""
        memo = self.__dict__.setdefault("memo", _Memo(len(self.langs)))
        at = memo.find(keys)
        missing = at < 0
        if missing.any():
            new = np.unique(keys[missing])
            if not memo.room(len(new)):
                memo.clear()
                new = np.unique(keys)
                if not memo.room(len(new)):
                    return np.searchsorted(new, keys), self._costs(new)
                missing[:] = True
            memo.add(new, self._costs(new))
            at[missing] = memo.find(keys[missing])
        return at, memo.cost

    def _costs(self, keys: np.ndarray) -> np.ndarray:
        return np.concatenate([self._cost(keys[a : a + CHUNK]) for a in range(0, max(len(keys), 1), CHUNK)])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def _cost(self, keys: np.ndarray) -> np.ndarray:
        """Bits of symbols (lowest byte) after contexts (the bytes above it, up to the first zero)."""
        n_langs = len(self.langs)
        cost = np.zeros((len(keys), n_langs))
        active = np.arange(len(keys))
        length = np.zeros(len(keys), np.int64)
        whole_context = np.ones(len(keys), bool)
        for k in range(1, self.order + 1):
            whole_context &= (keys >> np.uint64(8 * k)) & np.uint64(255) != 0
            length += whole_context
        done = np.zeros((len(keys), n_langs), bool)
        begun = done.copy()  # a longer context of this language was visited
        banned, n_banned = np.zeros(done.shape), np.zeros(done.shape)
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            if not len(level.grams):
                continue
            use = length[active] >= k
            grams = keys[active] & np.uint64((1 << (8 * (k + 1))) - 1)
            found = np.minimum(np.searchsorted(level.grams, grams), len(level.grams) - 1)
            hit = use & (level.grams[found] == grams)
            context = grams >> np.uint64(8)
            node = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
            there = use & (level.contexts[node] == context)
            total, distinct = level.total[node].astype(np.float64), level.distinct[node].astype(np.float64)
            known = there[:, None] & (total > 0) & ~done
            room = np.where(begun, distinct - n_banned, distinct)  # escapes: symbols not excluded
            whole = np.where(begun, total - banned, total) + room
            count = np.where(hit[:, None], level.counts[found], 0)
            final = known & (count > 0) & (whole > 0)
            escape = known & ~final & (room > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                cost[active] += np.where(final, -np.log2(count / whole), np.where(escape, -np.log2(room / whole), 0.0))
            done |= final
            banned = np.where(known, level.excluded[node], banned)
            n_banned = np.where(known, distinct, n_banned)
            begun |= known
        return cost + np.where(done, 0.0, np.log2(np.maximum(256 - np.where(begun, n_banned, 0), 1)))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG, order: int = ORDER) -> ContextTrees:
    """Trees of every non-null language of ``labelled``. Rows without text teach nothing."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    share = F.lit(0)
    for name in langs:
        share = F.when(F.col("l") == name, F.lit(min(1_000_000, docs_per_lang * 1_000_000 // sizes[name] + 1))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < share)
    counted = chosen.select("l", F.explode(words_of(F.lower("t"))).alias("w")).groupBy("l", "w").agg(F.count(F.lit(1)).alias("n")).toArrow()
    names = counted["l"].combine_chunks().dictionary_encode()
    number = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int64)
    codes = number[names.indices.to_numpy()] if len(number) else np.zeros(0, np.int64)
    return ContextTrees(counted["w"], codes, counted["n"].to_numpy().astype(np.float64), langs, order)


def identify(docs: DataFrame, trees: ContextTrees, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all, if none are named) of every row, then lang_pred, score and bits_per_byte.

    Null texts and texts without a letter: ``und``, score 0, null bits_per_byte.
    Of languages with equal code lengths the first by name is taken. Input
    columns of these three names are dropped. Only the text goes to Python, in
    slices; the other columns stay where they are.
    """
    added = ("lang_pred", "score", "bits_per_byte")
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = model.value
        names = np.array([*trees.langs, UNKNOWN], object)
        cache = WordCache(trees.bits, max(10_000, min(200_000, MEMORY // (8 * len(trees.langs) + 8))))
        for column in columns:
            best, post, rate = np.full(len(column), len(trees.langs)), np.zeros(len(column)), np.full(len(column), np.nan)
            for a, b, texts in text_slices(column):
                texts = [t if t.isascii() and t.islower() else t.decode().lower().encode() for t in texts]
                words, counts = split_slice(texts)
                if not words or not trees.langs:
                    continue
                at, table = cache.look_up(words)
                bits = sum_by_text(table[at], counts)
                low = bits.min(axis=1)
                sizes = np.fromiter((len(t) + 1 for t in texts), np.float64, b - a)
                here = counts > 0
                best[a:b] = np.where(here, bits.argmin(axis=1), best[a:b])
                post[a:b] = np.where(here, 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1), 0)
                rate[a:b] = np.where(here, low / sizes, np.nan)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(post), pa.array(rate, from_pandas=True)], names=list(added))

    judged = F.arrow_udf(judge, "lang_pred string, score double, bits_per_byte double")
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(kept)], lettered, judged(F.col(text)).alias("__judged"))
    found = F.col("__judged")
    values = (
        F.when(F.col("__letter"), found["lang_pred"]).otherwise(F.lit(UNKNOWN)),
        F.when(F.col("__letter"), found["score"]).otherwise(F.lit(0.0)),
        F.when(F.col("__letter"), found["bits_per_byte"]),
    )
    return rows.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)], *[v.alias(n) for n, v in zip(added, values, strict=True)])


def train_and_identify(docs: DataFrame, learn: Column | None = None, keep: list[str] | None = None, **options: object) -> DataFrame:
    """Learns from the rows for which ``learn`` holds (all, if none), then identifies every row."""
    return identify(docs, train(docs if learn is None else docs.where(learn), **options), keep=keep)


def keep_documents(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", least: float = 0.5, most_bits: float = 6.5, **options: object) -> DataFrame:
    """The documents with a language: at least ``least`` likely, and coded in no more than ``most_bits`` a byte. Columns stay as they were."""
    safe = [f"k{i}" for i in range(len(docs.columns))]
    names = dict(zip(docs.columns, safe, strict=True))
    renamed = docs.toDF(*safe)
    found = identify(renamed, train(renamed, names[text], names[lang], names[key], **options), names[text])
    fine = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least) & (F.col("bits_per_byte") <= most_bits)
    return found.where(fine).select(*safe).toDF(*docs.columns)
