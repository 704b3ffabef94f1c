"""Exact top-k search by columnar branch and bound.

Vectors become integers, floor(scale * x), and are kept by dimension (one
contiguous column each). For a query, inner products are summed up block of
dimensions by block; after each block a candidate's score is at most its sum so
far plus the product of what is left of both vectors' lengths, and candidates
whose bound is below the k-th best score are dropped by compacting the columns
that follow. Dimensions go by falling mass of the queries.

Queries are a stated subset; they go to the candidates in blocks of at most
``BLOCK`` (a fixed size, held by the driver one block at a time), each block
scans all candidates, and a task keeps k rows per query. The rest is an
aggregate of k rows per query and task.

Vectors that are null or hold a null, NaN or infinite component take no part,
nor do candidates of another dimension than the query's. Rows with a query's own
id are not its candidates; repeated rows of other ids count each. Pairs in which
a vector is too large for sums that 53 bits hold exactly are scored one by one
in Python's integers; a score among the k best that 64 bits don't hold is an
error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
SCALE = 1024
BLOCK = 4096
STEP = 8  # dimensions in a block
CHUNK = 16_384  # candidates in a column
_EXACT = 1 << 18  # components held as Python integers at a time


def _valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    value = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # coalesce: a null array is not valid
    return vectors.where(F.coalesce(fine, F.lit(False)) & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), value.alias("v"))


def plain(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Rows whose inner products with each other stay below 2^53, so that bounds and sums are exact."""
    with np.errstate(over="ignore"):
        whole = np.floor(vectors * float(scale))
    return (np.abs(whole) <= math.isqrt((1 << 53) // max(vectors.shape[1], 1))).all(axis=1)


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(vectors * float(scale)).astype(np.int64)


def exact_integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The same in Python's integers, for components of any size."""

    def whole(x: float) -> int:
        return math.floor(y) if math.isfinite(y := x * float(scale)) else int(x) * scale

    return np.array([whole(x) for x in vectors.ravel().tolist()], object).reshape(vectors.shape)


def exact_search(own_id: int, query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, scale: int) -> list[tuple[int, int]]:
    """(-score, id) of the k best candidates, each scored in Python's integers."""
    best: list[tuple[int, int]] = []
    step = max(1, _EXACT // max(vectors.shape[1], 1))
    for a in range(0, len(ids), step):
        scores = exact_integers(vectors[a : a + step], scale) @ query
        best = sorted([*best, *((-s, i) for s, i in zip(scores.tolist(), ids[a : a + step].tolist(), strict=True) if i != own_id)])[:k]
    return best


class Columns:
    """A chunk of candidates in vertical layout, in the order of dimensions given."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray, order: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")  # ties go to smaller ids
        self.ids = ids[by_id]
        self.columns = np.ascontiguousarray(whole[by_id][:, order].T)
        mass = np.cumsum((self.columns.astype(np.float64) ** 2)[::-1], axis=0)[::-1]
        #: Length of what is left of each vector before each block, rounded up.
        self.left = [np.sqrt(mass[d]) * (1 + 1e-9) for d in range(0, len(order), STEP)]

    def search(self, own_id: int, query: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best candidates here, but none that is below ``floor``."""
        alive = np.flatnonzero(self.ids != own_id)
        total = np.zeros(len(alive), np.int64)
        rest = np.sqrt(np.cumsum((query.astype(np.float64) ** 2)[::-1])[::-1]) * (1 + 1e-9)
        whole = len(alive) == len(self.ids)
        for block, d in enumerate(range(0, len(query), STEP)):
            if len(alive) > k or floor is not None:
                reach = rest[d] * self.left[block][alive]
                least = floor
                if len(alive) > k:  # k candidates reach at least this
                    sure = total - reach
                    kth = np.partition(sure, len(sure) - k)[len(sure) - k]
                    least = kth if least is None else max(least, kth)
                stay = total + reach >= least
                if not stay.all():
                    alive, total, whole = alive[stay], total[stay], False
            if not len(alive):
                break
            part = self.columns[d : d + STEP]
            total = total + query[d : d + STEP] @ (part if whole else part[:, alive])
        if len(alive) > k:
            kth = np.partition(total, len(total) - k)[len(total) - k]
            fine = total >= kth
            alive, total = alive[fine], total[fine]
        best = np.lexsort((self.ids[alive], -total))[:k]
        return total[best], self.ids[alive][best]


def _search_block(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, scale: int) -> DataFrame:
    small = plain(queries, scale)
    turned = integers(np.where(small[:, None], queries, 0), scale)
    order = np.argsort(-(turned.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    turned = turned[:, order]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id)
        width = turned.shape[1]

        def look(own: list[np.ndarray], vectors: list[np.ndarray]) -> None:
            own_ids, values = np.concatenate(own), np.concatenate(vectors)
            fine = plain(values, scale)
            columns = Columns(own_ids[fine], integers(values[fine], scale), order) if fine.any() else None
            for q in range(len(ids)):
                if small[q] and columns is not None:
                    floor = -best[q][k - 1][0] if len(best[q]) >= k else None
                    if floor is not None and abs(floor) > 1 << 53:  # an exact score
                        floor = None
                    scores, found = columns.search(int(ids[q]), turned[q], k, floor)
                    if len(found):
                        best[q] = sorted([*best[q], *zip((-scores).tolist(), found.tolist(), strict=True)])[:k]
                rest = ~fine if small[q] else np.ones(len(fine), bool)
                if rest.any():
                    more = exact_search(int(ids[q]), exact_integers(queries[q], scale), own_ids[rest], values[rest], k, scale)
                    best[q] = sorted([*best[q], *more])[:k]

        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        n = 0
        for batch in batches:
            values = batch.column(1)
            sizes = values.value_lengths().to_numpy(zero_copy_only=False)
            flat, offsets = values.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            fits = np.flatnonzero(sizes == width)
            if len(fits):
                held[0].append(batch.column(0).to_numpy()[fits])
                held[1].append(flat[offsets[fits][:, None] + np.arange(width)])
                n += len(fits)
            if n >= CHUNK:
                look(*held)
                held, n = ([], []), 0
        if n:
            look(*held)
        rows = [(int(ids[q]), i, -s) for q in range(len(ids)) for s, i in best[q]]
        if rows:
            if any(not -(1 << 63) <= r[2] < 1 << 63 for r in rows):
                raise OverflowError("the score of a query's best candidates exceeds 64 bits")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(search, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: Column, k: int = K, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows for which ``queries`` holds; a query without a candidate has no row."""
    candidates = _valid(vectors, key, vector)
    asked = _valid(vectors.where(queries), key, vector).dropDuplicates(["id"]).withColumn("width", F.size("v"))
    found = None
    groups = asked.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy("width").collect()
    for width, n in ((r["width"], r["n"]) for r in groups if r["width"]):
        own = asked.where(F.col("width") == width)
        for b in range(n_blocks := -(-n // block)):
            part = own if n_blocks == 1 else own.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b)
            rows = part.orderBy("id").collect()
            if rows:
                one = _search_block(candidates, np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows], np.float64), k, scale)
                found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
