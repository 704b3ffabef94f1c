"""The lattice of vocabulary pieces over a word, for many words at once.

A piece of the vocabulary is a string of bytes; a blank starts a word. Every
byte also has a piece of its own, so each word can be segmented. The scores of
a merge-ranked vocabulary are ranks, not log probabilities, so a piece's weight
is taken from its rank by Zipf's law, ``1 / (rank + SHIFT)``; byte pieces share
``BYTES`` of the mass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lexmill.llm.common import Finder

SHIFT = 50.0
BYTES = 0.01
_BASE = np.uint64(0x9E3779B97F4A7C15)
MARK = "▁"
#: Words up to this many bytes share a batch with words of the same size only.
SAME_SIZE = 40


@dataclass
class Vocabulary:
    """pieces[i] has id ids[i]; the last 256 are the single bytes in order. logs: natural log weights."""

    pieces: list[bytes]
    ids: np.ndarray
    logs: np.ndarray

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        """All pieces, with blanks for ``MARK``, but for special ones. A piece that its score all but rules out keeps that score."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces, ids, ranks, byte_ids = [], [], [], np.zeros(256, np.int64)
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
                continue
            text = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i):
                continue
            pieces.append(text.replace(MARK, " ").encode())
            ids.append(i)
            ranks.append(max(-model.get_score(i), 0.0) if text != MARK else 0.0)
        weights = 1 / (np.array(ranks) + SHIFT)
        logs = np.log(np.concatenate([weights / weights.sum() * (1 - BYTES), np.full(256, BYTES / 256)]))
        return cls([*pieces, *(bytes([b]) for b in range(256))], np.concatenate([np.array(ids, np.int64), byte_ids]), logs)


class Lattice:
    """Finds the arcs of words and sums over their paths. Arrays are laid out by byte, then word."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.n_plain = vocabulary, len(vocabulary.pieces) - 256
        plain = vocabulary.pieces[: self.n_plain]
        self.sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        keys = np.zeros(len(plain), np.uint64)
        with np.errstate(over="ignore"):
            for size in np.unique(self.sizes).tolist():
                rows = np.flatnonzero(self.sizes == size)
                own = np.zeros(len(rows), np.uint64)
                for column in np.frombuffer(b"".join(plain[i] for i in rows.tolist()), np.uint8).astype(np.uint64).reshape(-1, size).T:
                    own = own * _BASE + column + np.uint64(1)
                keys[rows] = own
        self.finder, self.known_sizes = Finder(keys), set(self.sizes.tolist())

    def arcs(self, flat: np.ndarray) -> dict[int, np.ndarray]:
        """flat: (byte, word). For each size the piece that ends at each byte from byte size - 1 on, or -1."""
        most = len(flat)
        found: dict[int, np.ndarray] = {}
        plain = flat.astype(np.uint64) + np.uint64(1)
        keys = np.zeros(flat.shape, np.uint64)
        power = np.uint64(1)
        with np.errstate(over="ignore"):
            for size in range(1, min(max(self.known_sizes, default=1), most) + 1):
                keys[size - 1 :] += plain[: most - size + 1] * power
                power = power * _BASE
                if size in self.known_sizes:
                    got = self.finder.find(keys[size - 1 :].ravel())
                    got[(got >= 0) & (self.sizes[got] != size)] = -1
                    if size == 1 or (got >= 0).any():
                        found[size] = got.reshape(most - size + 1, -1)
        single = found.get(1)
        found[1] = flat.astype(np.int32) + self.n_plain if single is None else np.where(single >= 0, single, flat.astype(np.int32) + self.n_plain)
        return found

    def batches(self, words: list[bytes]) -> list[np.ndarray]:
        """Word numbers by size, for long words by similar size, so many bytes at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        own = sizes[order]
        classes = np.where(own <= SAME_SIZE, own, SAME_SIZE + np.ceil(np.log2(np.maximum(own, 1)) * 2))
        cuts, begin = [], 0
        for end in [*(np.flatnonzero(np.diff(classes)) + 1).tolist(), len(order)]:
            step = max(1, 200_000 // max(int(sizes[order[end - 1]]), 1)) if end > begin else 1
            cuts += [order[i : min(i + step, end)] for i in range(begin, end, step)]
            begin = end
        return [c for c in cuts if len(c)]

    def forward(self, words: list[bytes], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """alpha (bytes so far, word), sizes, arcs."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        most = int(sizes.max())
        flat = np.frombuffer(b"".join(words) if int(sizes.min()) == most else b"".join(w.ljust(most, b"\0") for w in words), np.uint8)
        flat = np.ascontiguousarray(flat.reshape(len(words), most).T)
        arcs = self.arcs(flat)
        alpha = np.empty((most + 1, len(words)))
        alpha[0] = 0
        for j in range(1, most + 1):
            top = alpha[j - 1] + logs[arcs[1][j - 1]]
            first, into = top.copy(), []
            for size, a in arcs.items():
                if 1 < size <= j:
                    ends = a[j - size]
                    rows = np.flatnonzero(ends >= 0)
                    if len(rows):
                        x = alpha[j - size][rows] + logs[ends[rows]]
                        into.append((rows, x))
                        top[rows] = np.maximum(top[rows], x)
            if into:
                total = np.exp(first - top)
                for rows, x in into:
                    total[rows] += np.exp(x - top[rows])
                top += np.log(total)
            alpha[j] = top
        return alpha, sizes, arcs

    def marginals(self, words: list[bytes], logs: np.ndarray | None = None) -> np.ndarray:
        """Natural log of the summed weight of all segmentations of each word. Words start with a blank."""
        out = np.zeros(len(words))
        logs = self.vocabulary.logs if logs is None else logs
        for numbers in self.batches(words):
            alpha, sizes, _ = self.forward([words[i] for i in numbers.tolist()], logs)
            out[numbers] = alpha[sizes, np.arange(len(numbers))]
        return out

    def expected(self, words: list[bytes], weights: np.ndarray, logs: np.ndarray | None = None) -> np.ndarray:
        """Expected use of each piece over all segmentations, each word counted ``weights`` times."""
        logs = self.vocabulary.logs if logs is None else logs
        use = np.zeros(len(logs))
        for numbers in self.batches(words):
            alpha, sizes, arcs = self.forward([words[i] for i in numbers.tolist()], logs)
            n, most = len(numbers), len(alpha) - 1
            whole, weight, columns = alpha[sizes, np.arange(n)], weights[numbers], np.arange(n)
            # Backwards, a cell keeps its greatest term and the sum of all relative to it: no term is ever lost to range.
            top, total = np.full((most + 1, n), -np.inf), np.zeros((most + 1, n))
            top[sizes, columns], total[sizes, columns] = 0.0, 1.0
            pieces, shares = [], []
            for j in range(most, 0, -1):
                with np.errstate(divide="ignore"):
                    beta = top[j] + np.log(total[j])
                for size, a in arcs.items():
                    if size > j:
                        continue
                    ends = a[j - size]
                    rows = np.flatnonzero((ends >= 0) & (beta > -np.inf))
                    if not len(rows):
                        continue
                    own = ends[rows]
                    step = beta[rows] + logs[own]
                    pieces.append(own)
                    shares.append(np.exp(alpha[j - size][rows] + step - whole[rows]) * weight[rows])
                    old = top[j - size][rows]
                    new = np.maximum(old, step)
                    total[j - size][rows] = total[j - size][rows] * np.exp(old - new) + np.exp(step - new)
                    top[j - size][rows] = new
            use += np.bincount(np.concatenate(pieces), weights=np.concatenate(shares), minlength=len(use))
        return use
