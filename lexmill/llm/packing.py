"""Best-fit packing of token sequences, improved by swap-based local search.

Tokenised documents are cut into pieces of at most ``capacity`` tokens; pieces
are dealt evenly into groups of about ``GROUP``, and every group is packed alone:
best fit, longest first, then local search. A move takes a document to a fuller
bin, an exchange gives one or two documents of a bin for a shorter one of a
fuller bin; each raises the sum of squared fills, so light bins get lighter until
they are empty. The search ends where no bin can improve. What lies in bins that
are less than ``FULL`` full is dealt and packed once more, over all groups, so
the whole corpus loses about one bin in ``GROUP`` squared pieces. Only numbers are
shuffled, never texts.

Rows with null or repeated ids are documents of their own like all others; an
empty table gives an empty one.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import Finder, WordIndex, checkpointed, last_keys, text_slices

CAPACITY = 4096
GROUP = 4096
END = 1
#: Bins with less are packed once more, across groups.
FULL = 0.98


_NO_MERGE = np.int32(2**31 - 1)


class WordMerges:
    """Byte-pair merges of many words at once.

    For words of at most 48 small letters (a-z and U+00DF to U+00FF but the
    division sign), which the tokenizer neither changes nor takes apart: the same merges
    in the same order as the tokenizer's own, the pair of least rank first and
    of equal ones the leftmost.
    """

    WORD = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]){1,48})([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, tokenizer_file: str) -> None:
        with open(tokenizer_file, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(shown)]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(others)}
        self.inner = np.array([vocabulary.get(letters[b], -1) for b in range(256)], np.int64)
        self.final = np.array([vocabulary.get(letters[b] + end, -1) for b in range(256)], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right = (np.array([vocabulary[p[side]] for p in pairs], np.uint64) for side in (0, 1))
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.finder = Finder((left << np.uint64(32)) | right)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.finder.find((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))
        return np.where(found >= 0, found, _NO_MERGE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes).tolist():
            numbers = np.flatnonzero(sizes == size)
            for a in range(0, len(numbers), step := max(1, 400_000 // size)):
                rows = numbers[a : a + step]
                flat = np.frombuffer(b"".join(map(words.__getitem__, rows.tolist())), np.uint8).reshape(-1, size)
                ids = self.inner[flat]
                ids[:, -1] = self.final[flat[:, -1]]
                ranks = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), size - 1)
                while ids.shape[1] > 1:
                    at = ranks.argmin(axis=1)
                    line = np.arange(len(rows))
                    best = ranks[line, at]
                    done = best == _NO_MERGE
                    if done.any():
                        counts[rows[done]] = ids.shape[1]
                        found.append((rows[done], ids[done]))
                        rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
                        if not len(rows):
                            break
                        line = np.arange(len(rows))
                    # The pair becomes one id; what is right of it moves up.
                    keep = np.ones(ids.shape, bool)
                    keep[line, at + 1] = False
                    ids[line, at] = self.made[best]
                    width = ids.shape[1] - 1
                    ids = ids[keep].reshape(len(line), width)
                    keep = np.ones(ranks.shape, bool)
                    keep[line, at] = False
                    ranks = ranks[keep].reshape(len(line), width - 1)
                    before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
                    ranks[before, at[before] - 1] = self._ranks(ids[before, at[before] - 1], ids[before, at[before]])
                    ranks[after, at[after]] = self._ranks(ids[after, at[after]], ids[after, at[after] + 1])
                if len(rows):
                    counts[rows] = ids.shape[1]
                    found.append((rows, ids))
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        for rows, ids in found:
            out[begin[rows][:, None] + np.arange(ids.shape[1])] = ids
        return counts, out


class ChunkTokens:
    """Ids of blank-free chunks, each tokenised once per worker.

    The tokenizer never joins text across white space, lower-cases it, and parts
    a letter from a symbol after it, so a document's ids are those of its
    lower-cased chunks, one after the other, and a chunk's may be those of its
    word and of its symbols. Words of small letters go to ``WordMerges``, other
    chunks to the tokenizer.
    """

    def __init__(self, tokenizer_file: str, limit: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.merges, self.limit = Tokenizer.from_file(tokenizer_file), WordMerges(tokenizer_file), limit
        self.forget()

    def forget(self) -> None:
        self.index = WordIndex()
        self.ids, self.begin, self.size = np.empty(1 << 16, np.uint32), np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int64)
        self.n_ids = 0

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        if n <= len(array):
            return array
        more = np.empty(max(2 * len(array), n), array.dtype)
        more[: len(array)] = array
        return more

    def _add(self, known: int) -> None:
        """Ids of the chunks numbered from ``known`` on, and of words and symbols that have no number yet."""
        index, match = self.index, WordMerges.WORD.fullmatch
        words, others, split = [], [], []
        numbers, other_numbers = [], []
        for number, chunk in enumerate(last_keys(index, len(index) - known), known):
            found = match(chunk)
            if found is None:
                others.append(chunk)
                other_numbers.append(number)
            elif found.end(1) == len(chunk):
                words.append(chunk)
                numbers.append(number)
            else:
                own = len(index)
                word, symbols = found.groups()
                split.append((number, index[word], index[symbols]))
                if len(index) > own:  # new: numbered just now
                    if index[word] >= own:
                        words.append(word)
                        numbers.append(index[word])
                    if index[symbols] >= own:
                        others.append(symbols)
                        other_numbers.append(index[symbols])
        self.begin, self.size = self._room(self.begin, len(index)), self._room(self.size, len(index))
        if words:
            self._put(np.array(numbers, np.int64), *self.merges.encode(words))
        if others:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in others], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self._put(np.array(other_numbers, np.int64), sizes, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())))
        if split:
            whole, word, symbols = np.array(split, np.int64).T
            self._put(whole, self.size[word] + self.size[symbols], self._ids(np.stack([word, symbols], axis=1).ravel()))

    def _put(self, numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.ids = self._room(self.ids, self.n_ids + len(ids))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.begin[numbers], self.size[numbers] = self.n_ids + np.cumsum(sizes) - sizes, sizes
        self.n_ids += len(ids)

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.begin[numbers] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, without an end."""
        # A special token's string is not lower-cased into being.
        parts = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.index) > self.limit:
            self.forget()
        known = len(self.index)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        if len(self.index) > known:
            self._add(known)
        cut = np.concatenate([[0], np.cumsum(self.size[at])])[np.cumsum(counts)]
        return np.split(self._ids(at), cut[:-1]) if len(cut) else []


_tokens: dict[str, ChunkTokens] = {}


def _chunk_tokens(tokenizer_file: str) -> ChunkTokens:
    """This worker's tokenizer and what it has tokenised, kept from task to task."""
    if tokenizer_file not in _tokens:
        _tokens[tokenizer_file] = ChunkTokens(tokenizer_file)
    return _tokens[tokenizer_file]


def pieces(docs: DataFrame, tokenizer_file: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for): each document's ids, then ``end``, cut into pieces.

    A null text counts as empty: one piece, the end alone. Every row is a
    document of its own, also where ids repeat.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last = _chunk_tokens(tokenizer_file), np.array([end], np.uint32)
        for batch in batches:
            owners = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch.column(1)):
                rows = []
                for owner, ids in zip(owners[a:b], tokens.encode(texts), strict=True):
                    ids = np.concatenate([ids, last])
                    for n, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity].astype("<u4", copy=False)
                        rows.append((owner, n, start, len(own), zlib.crc32(own.tobytes()), *[own.astype(np.int32)] * with_ids))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has exactly r left
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fits = open_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            where = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, where = capacity, len(bins)
            bins.append([])
        bins[where].append(item)
        left = room - size
        if left:
            by_room[left].append(where)
            open_rooms |= 1 << left
    return bins


def _exchange(lengths: np.ndarray, source: list[int], targets: list[list[int]], room: np.ndarray) -> tuple[int, list[int], int] | None:
    """(target, given, taken) of the largest gain among all exchanges of one or two documents for a shorter one; None if there is none.

    What counts of a document is its length: a bin holds few distinct ones, and
    of all documents of one length in the targets the one with most room.
    """
    by_length: dict[int, list[int]] = {}
    for i in source:
        by_length.setdefault(int(lengths[i]), []).append(i)
    own = sorted(by_length)
    offers: dict[int, list[int]] = {}
    for n, x in enumerate(own):
        for y in own[n:]:
            if x != y or len(by_length[x]) > 1:
                offers.setdefault(x + y, [by_length[x][0], by_length[y][-1]])
    offers |= {x: [by_length[x][0]] for x in own}  # one document rather than two of the same sum
    given = np.array(sorted(offers), np.int64)
    owner = np.repeat(np.arange(len(targets)), [len(b) for b in targets])
    item = np.array([i for b in targets for i in b], np.int64)
    # Of each length in the targets the document with most room around it.
    order = np.lexsort((item, -room[owner], lengths[item]))
    owner, item = owner[order], item[order]
    first = np.ones(len(item), bool)
    first[1:] = lengths[item[1:]] != lengths[item[:-1]]
    owner, item = owner[first], item[first]
    best: tuple[int, int, int] | None = None
    for a in range(0, len(given), 256):
        gain = given[a : a + 256, None] - lengths[item][None, :]
        gain = np.where((gain > 0) & (gain <= room[owner][None, :]), gain, 0)
        at = int(gain.argmax())
        k, column = divmod(at, len(item))
        if gain[k, column] > (best[0] if best else 0):
            best = (int(gain[k, column]), a + k, column)
    return best and (int(owner[best[2]]), offers[int(given[best[1]])], int(item[best[2]]))


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Moves and exchanges between underfull bins, each raising the sum of squared fills, until none can; empty bins go."""
    least = -(-int(lengths.sum()) // capacity)
    bins = [list(b) for b in bins]
    fill = [int(lengths[b].sum()) for b in bins]
    loose = {b for b, f in enumerate(fill) if f < capacity}
    kind = {b: tuple(sorted(lengths[bins[b]].tolist())) for b in loose}
    stuck: set[tuple] = set()  # bins of equal lengths are stuck together
    n_bins = len(bins)
    while n_bins > least and len(loose) > 1:
        source = min((b for b in loose if kind[b] not in stuck), key=lambda b: (fill[b], b), default=None)
        if source is None:
            break
        others = sorted(b for b in loose if b != source and fill[b] >= fill[source])
        if not others:
            stuck.add(kind[source])
            continue
        room = np.array([capacity - fill[b] for b in others])
        # A move: the longest document that some bin takes, into the bin with the least room for it.
        order = np.argsort(room, kind="stable")
        fits = [i for i in bins[source] if lengths[i] <= room[order[-1]]]
        if fits:
            i = max(fits, key=lambda i: (int(lengths[i]), -i))
            target = others[order[np.searchsorted(room[order], lengths[i])]]
            _shift(lengths, bins, fill, source, target, [i], [])
        elif found := _exchange(lengths, bins[source], [bins[b] for b in others], room):
            target = others[found[0]]
            _shift(lengths, bins, fill, source, target, found[1], [found[2]])
        else:
            stuck.add(kind[source])
            continue
        stuck.clear()
        kind |= {b: tuple(sorted(lengths[bins[b]].tolist())) for b in (source, target)}
        n_bins -= not bins[source]
        loose = {b for b in loose if 0 < fill[b] < capacity}
    return [b for b in bins if b]


def _shift(lengths: np.ndarray, bins: list[list[int]], fill: list[int], source: int, target: int, give: list[int], take: list[int]) -> None:
    for i in give:
        bins[source].remove(i)
    for i in take:
        bins[target].remove(i)
    bins[target] += give
    bins[source] += take
    gain = int(lengths[give].sum()) - (int(lengths[take].sum()) if take else 0)
    fill[source] -= gain
    fill[target] += gain


def _packed(rows: DataFrame, capacity: int, groups: int, again: bool) -> DataFrame:
    """Adds sequence_id, offset and fill; numbers of the second time differ from those of the first."""
    kept = rows.columns
    schema = rows.select(*kept).schema.add("sequence_id", "long").add("offset", "long").add("__fill", "long")

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        table = table.select(kept).sort_by([(c, "ascending") for c in ("doc_id", "piece", "length", "ids_crc32")])
        lengths = table.column("length").to_numpy()
        bins = local_search(lengths, best_fit(lengths, capacity), capacity)
        number, offset, full = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n, items in enumerate(bins):
            number[items] = n
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
            full[items] = lengths[items].sum()
        number += (key[0].as_py() << 32) + (again << 62)
        for name, values in (("sequence_id", number), ("offset", offset), ("__fill", full)):
            table = table.append_column(name, pa.array(values))
        return table

    # By the row's place, not by its id: ids may be null or repeat, and a long document has many pieces.
    dealt = rows.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(fill, schema)


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``; in each sequence the offsets leave no gap. ``rows`` is best a written table: it is read twice."""
    groups = max(1, rows.count() // group)
    if groups == 1:
        return _packed(rows, capacity, 1, False).drop("__fill")
    first = checkpointed(_packed(rows, capacity, groups, False), "packed")
    loose = F.col("__fill") < int(capacity * FULL)
    rest = first.where(loose)
    second = _packed(rest.select(*rows.columns), capacity, max(1, rest.count() // group), True)
    return first.where(~loose).unionByName(second).drop("__fill")


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, **columns: object) -> DataFrame:
    """Tokenises, cuts and packs every row of ``docs``. The pieces are kept in the shared folder between the two steps."""
    return pack(checkpointed(pieces(docs, tokenizer_file, capacity=capacity, **columns), "pieces"), capacity)
