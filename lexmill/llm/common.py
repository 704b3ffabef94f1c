"""What the operators of this subpackage share.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``: exactly what
``bytes.split()`` yields, so Python code works on UTF-8 bytes, not on ``str``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word as a Java regular expression, and what lies between words.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Documents whose words are held as Python objects at a time.
SLICE = 256


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "lexmill-checkpoints")
    return root.rstrip("/")


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table into the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    path = f"{checkpoint_root(df.sparkSession)}/lexmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``checkpointed`` from which all that is needed has been written elsewhere."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")


class Finder:
    """Row numbers of distinct 64-bit keys by open addressing, a quarter full at most; -1 for other keys."""

    _FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.rows[slot] < 0)
            place, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.keys[place], self.rows[place] = keys[left[taken]], left[taken]
            rest = np.ones(len(left), bool)
            rest[taken] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * self._FACTOR) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.rows[slot]
        wrong = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & self.mask
            row = self.rows[slot]
            out[wrong] = row
            still = (self.keys[slot] != keys[wrong]) & (row >= 0)
            wrong, slot = wrong[still], slot[still]
        return out


class WordIndex(dict):
    """Numbers distinct words in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class WordCache:
    """Rows computed once per distinct word and worker; forgotten when there are more than ``limit``.

    ``rows(words)`` gives, for new words, one array row each. The limit bounds
    memory only: a forgotten word is computed again with the same result.
    """

    def __init__(self, rows: Callable[[list[bytes]], np.ndarray], limit: int = 200_000) -> None:
        self.make, self.limit = rows, limit
        self.index, self.table = WordIndex(), None

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index of each word, table whose rows the indexes name)."""
        if len(self.index) > self.limit:
            self.index, self.table = WordIndex(), None
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if len(self.index) > known:
            new = list(self.index)[known:] if known < len(self.index) // 2 else list(last_keys(self.index, len(self.index) - known))
            made = self.make(new)
            if self.table is None:
                self.table = made
            else:
                if known + len(made) > len(self.table):
                    room = np.empty((max(2 * len(self.table), known + len(made)), *made.shape[1:]), made.dtype)
                    room[:known] = self.table[:known]
                    self.table = room
                self.table[known : known + len(made)] = made
        return at, self.table if self.table is not None else self.make([])


def last_keys(index: dict, n: int) -> list:
    """The n keys added last."""
    keys = reversed(index)
    return [next(keys) for _ in range(n)][::-1]


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; empty for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_slices(column: pa.Array, bytes_each: int = 4_000_000) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, last row, UTF-8 bytes) for runs of at most SLICE rows and about so many bytes; only one run is held at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()
    begin = size = 0
    for i, own in enumerate(sizes):
        size += own
        if i + 1 - begin >= SLICE or size >= bytes_each or i + 1 == len(sizes):
            yield begin, i + 1, texts_of(column.slice(begin, i + 1 - begin))
            begin, size = i + 1, 0


def split_slice(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of some texts, and how many each text has."""
    parts = [t.split() for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    return [w for p in parts for w in p], counts


def sum_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, ``counts[i]`` of them for text i."""
    ends = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    at = np.concatenate([[0], np.cumsum(counts)])
    return ends[at[1:]] - ends[at[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
