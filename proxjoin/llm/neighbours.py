"""Nearest neighbours by a block matrix join.

A block of queries of bounded size visits every partition of the vectors, where they lie: vectors are not shuffled, as
each of them meets all queries, and a block is as large as its heaps allow, since each block is one scan. Both sides are
int8 with a scale for each vector; the product of a tile of queries and a tile of vectors, with a bound on what rounding
may have changed, leaves few pairs that can still be among the nearest. Those are computed again in double precision
from the original vectors and go to the queries' heaps; the partitions' heaps are merged at the end. No pair is lost, so
recall is 1.

Defined results: vectors that are null, empty, zero or hold a null or a number that isn't finite take no part.
Vectors meet only those of their own length. A query meets no row of its own id. Rows with repeated ids are candidates
each. Ties go to the smaller id. Queries without candidates give no rows; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxjoin.llm.common import materialize, union_all

#: Bytes of a query block's original vectors; it bounds what is sent to the executors at once.
BLOCK_BYTES = 32 << 20
#: Queries and vectors of a tile.
TILE = 2048


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of what rounding took away, norms."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = np.finfo(np.float64).tiny
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    lost = x - codes * scale[:, None]
    return codes, scale, np.sqrt((lost * lost).sum(axis=1)), np.sqrt((x * x).sum(axis=1))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, in double precision and in order, so that equal rows have equal products."""
    total = a[:, 0] * b[:, 0]
    for d in range(1, a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


class Search:
    """Queries with the heaps of their nearest so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k, self.x = ids, k, vectors.astype(np.float64)
        codes, self.scale, self.lost, self.norm = quantise(self.x)
        # Sums of up to 1,040 products of int8 numbers are exact in single precision.
        self.kind = np.float32 if vectors.shape[1] <= 1040 else np.float64
        self.codes = codes.astype(self.kind)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def visit(self, ids: np.ndarray, vectors: np.ndarray, quantised: tuple | None = None) -> None:
        y = vectors.astype(np.float64)
        codes, scale, lost, norm = quantised or quantise(y)
        guess = (self.codes @ codes.astype(self.kind).T).astype(np.float64) * self.scale[:, None] * scale
        error = np.outer(self.norm + self.lost, lost) + np.outer(self.lost, norm)
        error = error * (1 + 1e-9) + 1e-12 * np.outer(self.norm, norm)
        low = guess - error
        low[self.ids[:, None] == ids] = -np.inf
        floor = self.least.copy()
        if low.shape[1] >= self.k:
            floor = np.maximum(floor, np.partition(low, -self.k, axis=1)[:, -self.k])
        q, v = np.nonzero((guess + error >= floor[:, None]) & (self.ids[:, None] != ids))
        for i, score, vec in zip(q.tolist(), product(self.x[q], y[v]).tolist(), (-ids[v]).tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (score, vec))
            elif (score, vec) > heap[0]:
                heapq.heapreplace(heap, (score, vec))
        self.least = np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.heaps])

    def rows(self) -> pa.RecordBatch:
        flat = [(int(i), -vec, score) for i, heap in zip(self.ids, self.heaps, strict=True) for score, vec in heap]
        a, b, c = zip(*flat, strict=True) if flat else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])


def _blocks(queries: DataFrame, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of queries of one length each; the driver holds one block of each length at a time."""
    held: dict[int, list] = {}
    for row in queries.toLocalIterator():
        n = len(row[1])
        held.setdefault(n, []).append(row)
        if len(held[n]) * n * 8 >= limit:
            yield n, np.array([r[0] for r in held[n]], np.int64), np.array([r[1] for r in held.pop(n)])
    for n, rows in held.items():
        yield n, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest by inner product."""
    spark = vectors.sparkSession
    some = vectors.where(F.col(key).isNotNull() & usable(F.col(vector)))
    parts: list[DataFrame] = []
    for n, ids, x in _blocks(some.where(is_query).select(key, F.col(vector).cast("array<double>")), block_bytes):
        sent = spark.sparkContext.broadcast((ids, x))

        def run(batches: Iterator[pa.RecordBatch], n=n, sent=sent) -> Iterator[pa.RecordBatch]:
            searches = [Search(sent.value[0][a : a + TILE], sent.value[1][a : a + TILE], k) for a in range(0, len(sent.value[0]), TILE)]
            for batch in batches:
                flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                vec_ids = batch.column("id").to_numpy(zero_copy_only=False)
                for a in range(0, len(vec_ids), TILE):
                    tile = flat[a : a + TILE].astype(np.float64)
                    quantised = quantise(tile)
                    for search in searches:
                        search.visit(vec_ids[a : a + TILE], tile, quantised)
            for search in searches:
                yield search.rows()

        same = some.where(F.size(vector) == n).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        parts.append(materialize(same.mapInArrow(run, "query_id long, vec_id long, score double")))
        sent.unpersist()
    if not parts:
        parts = [spark.createDataFrame([], "query_id long, vec_id long, score double")]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return union_all(parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
