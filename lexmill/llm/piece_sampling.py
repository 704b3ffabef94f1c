"""Sampled SentencePiece segmentations: forward filtering, backward sampling.

A text gets a blank in front and is taken apart before each run of blanks, after
each run of carriage returns and around other white space, where no piece of the
vocabulary crosses (``Sampler`` checks this). For a chunk, the
forward sums over its lattice give, at each byte, the chance of each piece that
may end there; a segmentation is drawn from the end backwards. The random
numbers are a counter's hash: of the row's key, the seed, the chunk's number in
the text and the step, so a row's segmentation never depends on its neighbours,
its partition or a retry. Decoding joins the pieces' bytes and takes off the
blank in front: it gives back the very text, as blanks are the only mark and
every byte has a piece.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lexmill.llm.common import WordIndex, last_keys, mix64, text_slices
from lexmill.llm.piece_lattice import Lattice, Vocabulary

_CHUNK = re.compile(rb" *[^ \t-\r]+\r*| +\r*|\r+|[\t\n\x0b\x0c]")
_GOLD = 0x9E3779B97F4A7C15


class Sampler:
    """Lattices of chunks, each built once per worker."""

    def __init__(self, model_file: str, sharpness: float = 1.0, limit: int = 150_000) -> None:
        self.vocabulary = Vocabulary.load(model_file)
        if any(len(_CHUNK.findall(p)) != 1 for p in self.vocabulary.pieces):
            raise ValueError(f"a piece of {model_file} has white space inside that no chunk holds")
        self.lattice, self.logs, self.limit = Lattice(self.vocabulary), self.vocabulary.logs * sharpness, limit
        sizes = np.fromiter(map(len, self.vocabulary.pieces), np.int64, len(self.vocabulary.pieces))
        n_ids = int(self.vocabulary.ids.max()) + 1
        #: Bytes of each id: where they begin in ``letters``, and how many there are.
        self.letters = np.frombuffer(b"".join(self.vocabulary.pieces), np.uint8)
        self.begin, self.width = np.zeros(n_ids, np.int64), np.zeros(n_ids, np.int64)
        self.begin[self.vocabulary.ids], self.width[self.vocabulary.ids] = np.cumsum(sizes) - sizes, sizes
        self.forget()

    def forget(self) -> None:
        self.index = WordIndex()
        self.end: list[np.ndarray] = []  # cell of each chunk's last byte
        self.size: list[np.ndarray] = []
        self.cells: list[np.ndarray] = [np.zeros(1, np.int64)]  # arcs up to each cell
        self.arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # cumulative chance, size, piece id
        self.n_cells = self.n_arcs = 0
        self.flat: tuple | None = None

    def _add(self, chunks: list[bytes]) -> None:
        ends, sizes = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        for numbers in self.lattice.batches(chunks):
            alpha, own, arcs = self.lattice.forward([chunks[i] for i in numbers.tolist()], self.logs)
            most, n = len(alpha) - 1, len(numbers)
            cell_of = np.cumsum(own) - own  # first cell of each chunk
            cell, kind, chance, piece = [], [], [], []
            for size in sorted(arcs):
                place, column = np.nonzero(arcs[size] >= 0) if size > 1 else (np.repeat(np.arange(most), n), np.tile(np.arange(n), most))
                end = place + size - 1
                inside = end < own[column] if int(own.min()) < most else slice(None)
                place, column, end = place[inside], column[inside], end[inside]
                found = arcs[size][place, column]
                cell.append(cell_of[column] + end)
                kind.append(np.full(len(end), size, np.int32))
                chance.append(np.exp(alpha[place, column] + self.logs[found] - alpha[end + 1, column]))
                piece.append(self.vocabulary.ids[found])
            cell, kind, chance, piece = (np.concatenate(x) for x in (cell, kind, chance, piece))
            some = chance > 0
            order = np.flatnonzero(some)[np.argsort(cell[some], kind="stable")]  # by cell, then size
            cell, chance = cell[order], chance[order]
            counts = np.bincount(cell, minlength=int(own.sum()))
            stop = np.cumsum(counts)
            rank = np.arange(len(cell)) - np.repeat(stop - counts, counts)
            for r in range(1, int(counts.max())):  # sums within a cell alone: its neighbours must not change a bit of them
                at = np.flatnonzero(rank == r)
                chance[at] += chance[at - 1]
            self.arcs.append((chance, kind[order], piece[order]))
            self.cells.append(self.n_arcs + stop)
            ends[numbers], sizes[numbers] = self.n_cells + cell_of + own - 1, own
            self.n_cells += len(counts)
            self.n_arcs += len(cell)
        self.end.append(ends)
        self.size.append(sizes)
        self.flat = None

    def _tables(self) -> tuple:
        if self.flat is None:
            self.end, self.size, self.cells = [np.concatenate(self.end)], [np.concatenate(self.size)], [np.concatenate(self.cells)]
            self.arcs = [tuple(np.concatenate(x) for x in zip(*self.arcs, strict=True))]
            self.flat = (self.end[0], self.size[0], self.cells[0], *self.arcs[0])
        return self.flat

    def encode(self, keys: list[str], texts: list[bytes], seed: int = 0) -> list[np.ndarray]:
        """Piece ids of one sampled segmentation of each text."""
        parts = [_CHUNK.findall(b" " + t) for t in texts]
        if len(self.index) > self.limit:
            self.forget()
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        if len(self.index) > known:
            self._add(last_keys(self.index, len(self.index) - known))
        end, size, cells, chance, length, piece = self._tables()
        with np.errstate(over="ignore"):
            rows = np.fromiter((xxhash.xxh3_64_intdigest(k, seed) for k in keys), np.uint64, len(keys))
            place = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            stream = mix64(np.repeat(rows, counts) + place.astype(np.uint64) * np.uint64(_GOLD))
        cell, left = end[at].copy(), size[at].copy()
        active, steps = np.arange(len(at)), []
        step = 0
        while len(active):
            with np.errstate(over="ignore"):
                u = (mix64(stream[active] + np.uint64(((step + 1) * _GOLD) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)) * 2.0**-53
            here = cell[active]
            arc, last = cells[here].copy(), cells[here + 1] - 1
            u *= chance[last]  # the sums are 1 but for rounding
            behind = np.flatnonzero((chance[arc] <= u) & (arc < last))
            while len(behind):
                arc[behind] += 1
                behind = behind[(chance[arc[behind]] <= u[behind]) & (arc[behind] < last[behind])]
            steps.append((active, piece[arc]))
            cell[active] -= length[arc]
            left[active] -= length[arc]
            active = active[left[active] > 0]
            step += 1
        taken = np.zeros(len(at), np.int64)
        for own, _ in steps:
            taken[own] += 1
        stop = np.cumsum(taken)
        ids = np.zeros(int(stop[-1]) if len(stop) else 0, np.int32)
        for n, (own, found) in enumerate(steps):
            ids[stop[own] - 1 - n] = found
        cut = np.concatenate([[0], stop])[np.cumsum(counts)]
        return np.split(ids, cut[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_all([ids])[0]

    def decode_all(self, rows: list[np.ndarray]) -> list[bytes]:
        """The text of each row of ids."""
        ids = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64, copy=False)
        width = self.width[ids]
        stop = np.cumsum(width)
        letters = self.letters[np.repeat(self.begin[ids] - (stop - width), width) + np.arange(int(stop[-1]) if len(stop) else 0)].tobytes()
        cut = np.concatenate([[0], stop])[np.cumsum([0, *map(len, rows)])].tolist()
        return [letters[a + 1 : b] for a, b in zip(cut, cut[1:], strict=False)]


_samplers: dict[tuple[str, float], Sampler] = {}


def _sampler(model_file: str, sharpness: float) -> Sampler:
    if (model_file, sharpness) not in _samplers:
        _samplers[model_file, sharpness] = Sampler(model_file, sharpness)
    return _samplers[model_file, sharpness]


def encode(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id", seed: int = 0, sharpness: float = 1.0, digest: bool = False) -> DataFrame:
    """Every row's key and ids; with ``digest`` instead of ids: n_pieces, ids_crc32, decoded_sha256 and lossless.

    A null text counts as empty: one blank. Rows with the same key and text get
    the same segmentation.
    """
    schema = docs.select(F.col(key)).schema
    schema = schema.add("n_pieces", "long").add("ids_crc32", "long").add("decoded_sha256", "string").add("lossless", "boolean") if digest else schema.add("ids", ArrayType(IntegerType()))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(model_file, sharpness)
        for batch in batches:
            keys = batch.column(1).to_pylist()
            for a, b, texts in text_slices(batch.column(2)):
                found = sampler.encode([k or "" for k in keys[a:b]], texts, seed)
                own = batch.column(0).slice(a, b - a)
                if not digest:
                    yield pa.RecordBatch.from_arrays([own, pa.array(found, pa.list_(pa.int32()))], names=[key, "ids"])
                    continue
                decoded = sampler.decode_all(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        own,
                        pa.array([len(ids) for ids in found], pa.int64()),
                        pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids in found], pa.int64()),
                        pa.array([sha256(d).hexdigest() for d in decoded]),
                        pa.array([d == t for d, t in zip(decoded, texts, strict=True)]),
                    ],
                    names=schema.names,
                )

    return docs.select(F.col(key), F.col(key).cast("string").alias("__key"), F.col(text).alias("__text")).mapInArrow(sample, schema)


def decode(encoded: DataFrame, model_file: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Every row's key and text; null ids give a null text."""
    schema = encoded.select(F.col(key)).schema.add("text", "string")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(model_file, 1.0)
        for batch in batches:
            texts = [None if x is None else sampler.decode(np.array(x, np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(key), F.col(ids)).mapInArrow(join, schema)
