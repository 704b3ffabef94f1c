"""Removal of repeated passages by Rabin-Karp hashes of word windows.

Every window of ``window`` consecutive words gets a rolling polynomial hash of
its words' hashes. A task looks at blocks of about ``BLOCK`` windows: of equal
windows in a block only the earliest is passed on, the others are known to be
repeats, so a passage that fills a third of the corpus reaches a reducer once a
block. Blocks deal their windows into buckets by the hash's top bits, as packed
arrays (hash, document, start), not as rows; a reducer finds, for each hash, the
earliest window of all blocks, and returns the others' places by document.
Finally each document's repeated windows merge into maximal intervals of words,
which are cut out. The number of buckets follows the size of the texts.

Two windows count as equal if their hashes are. A hash has ``hash_bytes`` bytes,
by the size of the corpus: so many that all pairs of windows together have a
chance of at most one in a hundred to share one by accident (61 bits at 10^8
windows, 93 bits at 10^13). Rows with the same id and text are
one document; rows with the same id and other texts are told apart by a text
hash. A null id is the smallest number; null and empty texts have no window.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import WordCache, mix64, split_slice, text_slices, texts_of

WINDOW = 20
BLOCK = 1_000_000
BUCKET = 3_000_000
#: Bytes of text for each word, at least, for the number of buckets.
BYTES_EACH = 6
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def hash_bytes(n_windows: int, bits: int) -> tuple[int, int]:
    """(bytes stored of a window's hash, bytes of a second hash), where the top ``bits`` of the hash are the bucket's number."""
    need = math.ceil(2 * math.log2(max(n_windows, 2)) + 5.7)
    if 56 + min(bits, 8) >= need:
        return 7, 0
    return 7 if bits >= 8 else 8, min(8, max(0, -(-(need - 64) // 8)))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, counts: np.ndarray, window: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start) of every window of texts with ``counts`` words each, by text and start."""
    n_windows = np.maximum(counts - window + 1, 0)
    owner = np.repeat(np.arange(len(counts)), n_windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = start + np.repeat(np.cumsum(counts) - counts, n_windows)
    rolled = np.zeros(max(len(hashes) - window + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        done = 0
        parts = [(hashes, 1)]  # hashes of runs of 1, 2, 4, ... words
        while parts[-1][1] * 2 <= window:
            last, n = parts[-1]
            factor = np.uint64(pow(base, n, 1 << 64))
            parts.append((last[: max(len(last) - n, 0)] * factor + last[n:], 2 * n))
        for run, n in reversed(parts):
            if done + n <= window:
                factor = np.uint64(pow(base, n, 1 << 64))
                rolled = rolled * factor + run[done : done + len(rolled)]
                done += n
    return mix64(rolled[at]), owner, start


def _planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian bytes, plane by plane: planes of zeros compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def _encode(ids: np.ndarray, marks: np.ndarray, start: np.ndarray, hashes: np.ndarray | None, width: int, more: np.ndarray | None = None, extra: int = 0) -> bytes:
    """Windows in order of their documents: ids and text hashes once a document, then starts, hashes and their further bytes."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(ids)))
    head = np.array([len(first), len(ids)], "<u4").tobytes()
    body = _planes(ids[first].view(np.uint64), 8) + _planes(marks[first], 4) + _planes(sizes, 4) + _planes(start, 4)
    return head + body + (_planes(hashes, width) + _planes(more, extra) if hashes is not None else b"")


def _decode(payload: bytes, width: int, extra: int = 0) -> tuple[np.ndarray, ...]:
    """ids, text hashes, starts, hashes (none: empty) and their further bytes of each window."""
    data = memoryview(payload)
    n_docs, n = (int(x) for x in np.frombuffer(data[:8], "<u4"))
    at, found = 8, []
    hashed = n if len(payload) > 8 + 16 * n_docs + 4 * n else 0
    for size, w in ((n_docs, 8), (n_docs, 4), (n_docs, 4), (n, 4), (hashed, width), (hashed, extra)):
        found.append(_unplanes(data[at:], size, w))
        at += size * w
    sizes = found[2].astype(np.int64)
    return np.repeat(found[0].view(np.int64), sizes), np.repeat(found[1], sizes), found[3].astype(np.int64), found[4], found[5]


class _Block:
    """Windows gathered by a task until there are enough of them."""

    def __init__(self, bits: int, width: int, extra: int) -> None:
        self.bits, self.width, self.extra = bits, width, extra
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids: list[int] = []
        self.marks: list[int] = []
        self.n = 0

    def add(self, ids: list[int], marks: list[int], hashes: np.ndarray, more: np.ndarray, owner: np.ndarray, start: np.ndarray) -> None:
        self.parts.append((hashes, more, owner + len(self.ids), start))
        self.ids += ids
        self.marks += marks
        self.n += len(hashes)

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, 0, windows to compare) and (bucket, 1, windows known to be repeats)."""
        if not self.n:
            return
        ids, marks = np.array(self.ids, np.int64), np.array(self.marks, np.uint64)
        order = np.lexsort((marks, ids))
        rank = np.empty(len(ids), np.int64)
        same = (np.diff(ids[order], prepend=ids[order[0]]) == 0) & (np.diff(marks[order].view(np.int64), prepend=0) == 0)
        same[0] = False
        rank[order] = np.cumsum(~same) - 1  # equal rows are one document
        ids, marks = ids[order][~same], marks[order][~same]
        hashes, more, owner, start = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        owner = rank[owner]
        by_place = np.lexsort((start, owner))
        hashes, more, owner, start = hashes[by_place], more[by_place], owner[by_place], start[by_place]
        by_hash = np.lexsort((more, hashes)) if self.extra else np.argsort(hashes, kind="stable")
        leads = _new(hashes[by_hash], more[by_hash])
        lead = by_hash[np.maximum.accumulate(np.where(leads, np.arange(len(leads)), 0))]  # earliest of the same hash
        repeat = np.zeros(len(hashes), bool)
        repeat[by_hash] = ~leads & ((owner[by_hash] != owner[lead]) | (start[by_hash] != start[lead]))
        first = np.zeros(len(hashes), bool)
        first[by_hash] = leads
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        if repeat.any():
            # These need no comparison; blocks deal them to any bucket, each to another.
            own = int(mix64(np.array([ids[0] ^ len(hashes)]).view(np.uint64))[0])
            yield own >> (64 - self.bits), 1, _encode(ids[owner[repeat]], marks[owner[repeat]], start[repeat], None, self.width)
        kept = np.flatnonzero(first)
        kept = kept[np.argsort(bucket[kept].astype(np.uint32), kind="stable")]
        numbers, begins = np.unique(bucket[kept], return_index=True)
        for number, own in zip(numbers.tolist(), np.split(kept, begins[1:]), strict=True):
            yield number, 0, _encode(ids[owner[own]], marks[owner[own]], start[own], hashes[own], self.width, more[own], self.extra)


def _new(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Where, in sorted hashes, another one begins."""
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1])
    return new


def _by_document(ids: np.ndarray, marks: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """A row for each document, with its starts as packed 32-bit numbers."""
    order = np.lexsort((start, marks, ids))
    ids, marks, start = ids[order], marks[order].astype(np.int64), start[order].astype("<u4")
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
    first = np.flatnonzero(new)
    offsets = (np.append(first, len(ids)) * 4).astype(np.int32)
    starts = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(start.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(marks[first]), starts], names=["__id", "__mark", "starts"])


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with __id (the smallest number for null) and __mark, 32 bits of a hash of the text."""
    return docs.withColumns({"__id": F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))), "__mark": F.coalesce(F.shiftrightunsigned(F.xxhash64(F.col(text)), 32), F.lit(0))})


def repeated_windows(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """__id, __mark, starts (packed): the windows of each document whose words also start earlier."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    bits = max(0, (int(size) // BYTES_EACH // BUCKET).bit_length())
    width, extra = hash_bytes(int(size) // BYTES_EACH, bits)
    mask = np.uint64((1 << 8 * extra) - 1 if extra < 8 else 0xFFFFFFFFFFFFFFFF)
    keyed = _keyed(docs, key, text).where(F.col(text).isNotNull()).select("__id", "__mark", F.col(text))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, block = WordCache(word_hashes), _Block(bits, width, extra)

        def flushed() -> Iterator[pa.RecordBatch]:
            for number, kind, payload in block.rows():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([kind], pa.int32()), pa.array([payload], pa.binary())], names=["bucket", "kind", "payload"])

        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, texts in text_slices(batch.column(2)):
                words, counts = split_slice(texts)
                if len(words) < window:
                    continue
                at, table = cache.look_up(words)
                hashes, owner, start = window_hashes(table[at], counts, window)
                more = window_hashes(mix64(table[at]), counts, window, _BASE2)[0] & mask if extra else np.zeros(len(hashes), np.uint64)
                block.add(ids[a:b], marks[a:b], hashes, more, owner, start)
                if block.n >= BLOCK:
                    yield from flushed()
                    block = _Block(bits, width, extra)
        yield from flushed()

    def compare(table: pa.Table) -> pa.Table:
        kinds, payloads = table.column("kind").to_pylist(), table.column("payload").to_pylist()
        parts = [_decode(p, width, extra) for k, p in zip(kinds, payloads, strict=True) if k == 0]
        out = [_decode(p, width)[:3] for k, p in zip(kinds, payloads, strict=True) if k == 1]
        if parts:
            ids, marks, start, hashes, more = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, marks, ids, more, hashes) if extra else (start, marks, ids, hashes))
            ids, marks, start, hashes, more = ids[order], marks[order], start[order], hashes[order], more[order]
            new = _new(hashes, more)
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            later = (ids != ids[lead]) | (marks != marks[lead]) | (start != start[lead])
            out.append((ids[later], marks[later], start[later]))
        ids, marks, start = (np.concatenate(x) for x in zip(*out, strict=True))
        group = (mix64(ids.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(ids), np.int64)
        order = np.lexsort((start, marks, ids, group))
        ids, marks, start, group = ids[order], marks[order], start[order], group[order]
        numbers, begins = np.unique(group, return_index=True)
        payloads = [_encode(i, m, s, None, width) for i, m, s in zip(*(np.split(x, begins[1:]) for x in (ids, marks, start)), strict=True)] if len(ids) else []
        return pa.table({"group": pa.array(numbers, pa.int32()), "payload": pa.array(payloads, pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        parts = [_decode(p, width)[:3] for p in table.column("payload").to_pylist()]
        return pa.Table.from_batches([_by_document(*(np.concatenate(x) for x in zip(*parts, strict=True)))])

    dealt = keyed.mapInArrow(deal, "bucket int, kind int, payload binary")
    repeats = dealt.groupBy("bucket").applyInArrow(compare, "group int, payload binary")
    return repeats.groupBy("group").applyInArrow(gather, "__id long, __mark long, starts binary")


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window: the union of the windows, as maximal intervals."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:-1]) > 0


def _apply(docs: DataFrame, made: list[tuple[str, pa.DataType, str]], make: Callable[[bytes, list[bytes], np.ndarray | None], tuple], window: int, text: str, key: str, kept: list[str]) -> DataFrame:
    """Columns ``kept`` of every document and those that ``make`` gets from its text, words and removal flags."""
    marks = repeated_windows(docs, window, text, key).groupBy("__id", "__mark").agg(F.collect_list("starts").alias("__starts"))
    rows = _keyed(docs, key, text).join(marks, ["__id", "__mark"], "left").select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__text"), "__starts")
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    for name, _, kind in made:
        schema = schema.add(name, kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, starts in zip(texts_of(batch.column(len(kept))), batch.column(len(kept) + 1).to_pylist(), strict=True):
                words = value.split()
                gone = None
                if starts:
                    gone = covered(len(words), np.concatenate([np.frombuffer(s, "<u4") for s in starts]).astype(np.int64), window)
                out.append(make(value, words, gone))
            columns = [pa.array(c, kind) for c, (_, kind, _) in zip(zip(*out, strict=True), made, strict=True)] if out else [pa.array([], kind) for _, kind, _ in made]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, *[n for n, _, _ in made]])

    return rows.mapInArrow(cut, schema)


def _kept(words: list[bytes], gone: np.ndarray | None) -> list[bytes]:
    return words if gone is None else [w for w, x in zip(words, gone.tolist(), strict=True) if not x]


def digest(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256. Null and empty texts: no words, the hash of the empty string."""

    def make(_: bytes, words: list[bytes], gone: np.ndarray | None) -> tuple:
        return len(words), 0 if gone is None else int(gone.sum()), hashlib.sha256(b" ".join(_kept(words, gone))).hexdigest()

    made = [("n_words", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")]
    return _apply(docs, made, make, window, text, key, [key])


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every document with its repeated passages cut out; the columns stay, ``n_chars``, if there is one, is counted again.

    A text from which nothing goes stays as it is; else the kept words are
    joined by one space. A null text stays null.
    """
    kept = [c for c in docs.columns if c != text]

    def make(value: bytes, words: list[bytes], gone: np.ndarray | None) -> tuple:
        return ((value if gone is None else b" ".join(_kept(words, gone))).decode(),)

    cut = _apply(docs.withColumn("__null", F.col(text).isNull()), [("__cut", pa.string(), "string")], make, window, text, key, [*kept, "__null"])
    cut = cut.withColumn(text, F.when(~F.col("__null"), F.col("__cut")))
    if "n_chars" in kept:
        cut = cut.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])
