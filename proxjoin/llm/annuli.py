"""Exact top-k search by inner product through a pivot-distance index.

The index. Vectors become whole numbers; each different vector is kept once, with the least k + 1 of its ids (no more of
them can be among a query's k). A further coordinate, sqrt(M^2 - |c|^2) with M the largest norm, makes all vectors
equally long, so that the nearest in Euclidean distance are those of the largest inner product. Vectors are keyed by their
nearest pivot and the distance to it, put in order of that key by ranges, and cut into annuli: runs of one pivot's
vectors, a table row each. Pivots are picked far apart from a bounded sample; they change how much is skipped, never a
result.

The search goes in rounds. A query orders annuli by the bound that the triangle inequality gives: what lies between
distances a and b from a pivot is no nearer than the query's own distance to it lies outside [a, b]. So around each pivot
it expands outwards from its own distance. In each round it visits the next annuli, four times as many as in the round
before, and stops when the next bound is below its (k + 1)-th best score. Pairs of an annulus and the queries that visit
it are compared by one matrix product, exactly: in double precision while all sums stay below 2^53, else by 64-bit numbers.

What is sent to every task is the list of annuli (``DIRECTORY`` entries at most, since annuli grow with the table beyond
``BLOCK`` x ``DIRECTORY`` vectors) and the pivots. Every round is stored, so a lost executor costs a part of one round.

Defined results: vectors that are null, empty, hold a null or an entry that isn't finite, or whose squared length is 2^62 or
more (scores would not fit 64 bits), and rows without an id take no part; zero vectors do. Vectors meet those of their own
length. Rows with the same id and vector count once; a query doesn't meet its own id and vector, but other vectors of a
repeated id are candidates and queries of their own. Ties go to the smaller id. Other columns aren't read. Queries
without candidates give no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxjoin.llm.common import materialize, union_all

SCALE = 256
#: Pivots at most, one for so many vectors at least, and bytes of the sample that they are picked from.
PIVOTS, PER_PIVOT, SAMPLE_BYTES = 64, 256, 2 << 20
#: Vectors of an annulus, and annuli in the list that is sent to tasks.
BLOCK, DIRECTORY = 1024, 1 << 18
#: Queries of a tile.
QUERIES = 1024
#: Bounds are computed for so many (query, annulus) pairs at a time.
BOUNDS = 1 << 21
#: Annuli of the first round.
FIRST, GROWTH = 1, 4
#: Squared lengths from here on give scores of more than 64 bits; sums below EXACT are exact in double precision.
LARGEST, EXACT = 2.0**62, 2**53
#: What a query without k + 1 scores has to reach.
NO_SCORE = -(2**63)


def usable(vector: Column) -> Column:
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    length = F.aggregate(vector, F.lit(0.0), lambda t, c: t + F.floor(c.cast("double") * SCALE).cast("double") * F.floor(c.cast("double") * SCALE).cast("double"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad) & (length < LARGEST), F.lit(False))


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("int"))


def _squared(vector: str) -> Column:
    return F.aggregate(vector, F.lit(0).cast("long"), lambda t, c: t + c.cast("long") * c.cast("long"))


def _rows(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


@dataclass(frozen=True)
class Space:
    """Vectors of one length with their largest squared length, and pivots in the space with the further coordinate."""

    largest: int
    pivots: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """The further coordinate of candidates."""
        return np.sqrt(np.maximum(self.largest - (x * x).sum(axis=1), 0).astype(np.float64))

    def to_pivots(self, x: np.ndarray, lift: np.ndarray) -> np.ndarray:
        near = np.empty((len(x), len(self.pivots)))
        for j, p in enumerate(self.pivots):
            gap = x - p[:-1]
            near[:, j] = np.sqrt((gap * gap).sum(axis=1) + (lift - p[-1]) ** 2)
        return near

    @property
    def kind(self) -> type:
        """The least type that holds an entry: none is longer than the largest vector."""
        return next(t for t in (np.int8, np.int16, np.int32) if self.largest <= np.iinfo(t).max ** 2 or t is np.int32)


def pick_pivots(sample: np.ndarray, largest: int, count: int) -> np.ndarray:
    """Rows of the sample, each as far from those before as any."""
    lift = Space(largest, np.empty((0, 0))).lifted(sample)
    points = np.column_stack([sample.astype(np.float64), lift])
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def different(rows: DataFrame, k: int) -> DataFrame:
    """(h, x, ids): each different vector with the least ``k`` of its ids, however many rows share it."""
    single = rows.select("id", "h", "x").distinct()
    least = Window.partitionBy("h", "x").orderBy("id")
    return single.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k).groupBy("h", "x").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def keyed(vectors: DataFrame, space: Space, lifted: bool) -> DataFrame:
    """``vectors`` with pivot and distance, in order of them. Queries have no further coordinate."""
    kinds = ", ".join(f"{n} {t}" for n, t in vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch)
            near = space.to_pivots(x, space.lifted(x) if lifted else np.zeros(len(x)))
            pivot = near.argmin(axis=1)
            more = [pa.array(pivot.astype(np.int64)), pa.array(near[np.arange(len(x)), pivot])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "pivot", "distance"])

    return vectors.mapInArrow(run, f"{kinds}, pivot long, distance double")


def cut(placed: DataFrame, space: Space, count: int) -> DataFrame:
    """The index: (block, pivot, low, high, ids, ends, x), an annulus in each row. ``ends`` are where a vector's ids end."""
    size = max(BLOCK, -(-count // DIRECTORY))
    parts = max(1, -(-count // (4 * size)))
    ordered = placed.repartitionByRange(parts, "pivot", "distance", "h").sortWithinPartitions("pivot", "distance", "h")

    def pack(held: list[tuple], number: int) -> dict:
        from pyspark import TaskContext

        ids = [r[3] for r in held]
        return {
            "block": [(TaskContext.get().partitionId() << 32) + number], "pivot": [held[0][0]], "low": [held[0][1]], "high": [held[-1][1]],
            "ids": [[i for some in ids for i in some]], "ends": [np.cumsum([len(some) for some in ids]).tolist()], "x": [np.array([r[2] for r in held]).astype(space.kind).tobytes()],
        }

    schema = pa.schema([("block", pa.int64()), ("pivot", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = 0
        for batch in batches:
            for row in zip(batch.column("pivot").to_pylist(), batch.column("distance").to_pylist(), _rows(batch), batch.column("ids").to_pylist(), strict=True):
                if held and (held[0][0] != row[0] or len(held) >= size):
                    yield pa.RecordBatch.from_pydict(pack(held, number), schema=schema)
                    held, number = [], number + 1
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pydict(pack(held, number), schema=schema)

    return ordered.mapInArrow(run, "block long, pivot long, low double, high double, ids array<long>, ends array<long>, x binary")


def bounds(space: Space, to_pivots: np.ndarray, squared: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """No vector of an annulus has a larger inner product with the query: (queries, annuli), a little too large."""
    d = to_pivots[:, pivot]
    gap = np.maximum(np.maximum(d - high, low - d), 0)
    slack = 1e-9 * (d + high + np.sqrt(float(space.largest)) + 1)
    gap = np.maximum(gap - slack, 0)
    total = squared[:, None] + float(space.largest)
    return (total - gap * gap) / 2 + 1e-9 * total + 1


def visits(queries: DataFrame, space: Space, directory: tuple, seen: int, step: int) -> DataFrame:
    """(block, q, least, x): for each annulus, queries whose turn it is in this round, with scores to reach and vectors."""
    schema = pa.schema([("block", pa.int64()), ("q", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())), ("x", pa.binary())])
    sent = queries.sparkSession.sparkContext.broadcast(directory)  # DIRECTORY annuli at most, beside a few for pivots and partitions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pivot, low, high = sent.value
        some = max(1, BOUNDS // len(block))
        for batch in (whole.slice(a, QUERIES) for whole in batches for a in range(0, len(whole), QUERIES)):
            x, q = _rows(batch), batch.column("q").to_numpy(zero_copy_only=False)
            least = pc.fill_null(batch.column("least"), NO_SCORE).to_numpy(zero_copy_only=False)
            turns: list[tuple[np.ndarray, np.ndarray]] = []
            for a in range(0, len(x), some):
                part = x[a : a + some]
                top = bounds(space, space.to_pivots(part, np.zeros(len(part))), (part * part).sum(axis=1).astype(np.float64), pivot, low, high)
                order = np.argsort(-top, axis=1, kind="stable")[:, seen : seen + step]
                i, j = np.nonzero(np.take_along_axis(top, order, axis=1) >= least[a : a + some, None])
                turns.append((i + a, order[i, j]))
            who, where = (np.concatenate(t) for t in zip(*turns, strict=True))
            by = np.argsort(where, kind="stable")
            who, where = who[by], where[by]
            for rows, at in zip(np.split(who, np.flatnonzero(np.diff(where)) + 1), np.unique(where), strict=True) if len(where) else ():
                yield pa.RecordBatch.from_pydict({"block": [int(block[at])], "q": [q[rows].tolist()], "least": [least[rows].tolist()], "x": [x[rows].astype(np.int32).tobytes()]}, schema=schema)

    return queries.mapInArrow(run, "block long, q array<long>, least array<long>, x binary")


def compared(tiles: DataFrame, space: Space, d: int, k: int) -> DataFrame:
    """(q, id, score): of each tile, every query's ``k`` best ids that reach its score."""
    exact = np.float64 if space.largest < EXACT else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.to_pylist():
                asked = np.frombuffer(tile["x"], np.int32).reshape(-1, d).astype(exact)
                there = np.frombuffer(tile["there"], space.kind).reshape(-1, d).astype(exact)
                score = (asked @ there.T).astype(np.int64)
                floor = np.array(tile["least"], np.int64)
                if len(there) > k:
                    floor = np.maximum(floor, np.partition(score, -k, axis=1)[:, -k])
                i, j = np.nonzero(score >= floor[:, None])
                ids, ends = np.array(tile["ids"], np.int64), np.array(tile["ends"], np.int64)
                starts = np.r_[0, ends[:-1]]
                many = (ends - starts)[j]
                at = np.repeat(starts[j] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                i, s, own = np.repeat(i, many), np.repeat(score[i, j], many), ids[at]
                order = np.lexsort((own, -s, i))
                i, s, own = i[order], s[order], own[order]
                first = np.searchsorted(i, i)  # where each query's run begins
                kept = np.arange(len(i)) - first < k
                yield pa.RecordBatch.from_arrays([pa.array(np.array(tile["q"], np.int64)[i[kept]]), pa.array(own[kept]), pa.array(s[kept])], ["q", "id", "score"])

    return tiles.mapInArrow(run, "q long, id long, score long")


def search(queries: DataFrame, index: DataFrame, space: Space, d: int, k: int) -> DataFrame:
    """(q, id, score): each query's ``k`` best, of the queries (q, x)."""
    held = index.select("block", "pivot", "low", "high").orderBy("pivot", "low", "block").collect()  # DIRECTORY rows, see above
    directory = tuple(np.array([r[i] for r in held]) for i in range(4))
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best: DataFrame | None = None
    seen, step = 0, FIRST
    while seen < len(held):
        waiting = queries.withColumn("least", F.lit(None).cast("long"))
        if best is not None:
            full = best.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).select("q", "least")
            waiting = queries.join(full, "q", "left")
        turns = materialize(visits(waiting.select("q", "x", "least"), space, directory, seen, step))
        if turns.isEmpty():
            break
        tiles = turns.join(index.select("block", "ids", "ends", F.col("x").alias("there")), "block").drop("block")
        found = compared(tiles, space, d, k)
        both = found if best is None else best.unionByName(found)
        best = materialize(both.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k).drop("n"))
        seen, step = seen + step, step * GROWTH
    return best if best is not None else queries.sparkSession.createDataFrame([], "q long, id long, score long")


def _of_length(rows: DataFrame, d: int, k: int) -> DataFrame:
    """(query_id, h, x, id, score): the ``k`` + 1 best of every query vector, for each of its ids."""
    candidates = materialize(different(rows, k + 1))
    count, largest = candidates.agg(F.count("*"), F.max(_squared("x"))).first()
    sample = candidates.select("h", "x").orderBy("h", "x").limit(max(1, SAMPLE_BYTES // (8 * d))).collect()  # SAMPLE_BYTES at most
    bare = Space(largest, np.empty((0, 0)))
    space = Space(largest, pick_pivots(np.array([r.x for r in sample], np.int64), bare.largest, min(PIVOTS, max(1, count // PER_PIVOT))))
    placed = materialize(keyed(candidates.select("h", "ids", "x"), space, True))
    index = materialize(cut(placed, space, count))
    asked = materialize(rows.where("asked").select("id", "h", "x").distinct())
    queries = keyed(asked.select("h", "x").distinct(), space, False).sort("pivot", "distance", "h").select(F.monotonically_increasing_id().alias("q"), "h", "x")
    queries = materialize(queries)
    best = search(queries.select("q", "x"), index, space, d, k + 1)
    answers = best.join(queries, "q")
    return asked.select(F.col("id").alias("query_id"), "h", "x").join(answers, ["h", "x"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product for every row that ``is_query``."""
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), whole(F.col(vector)).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.withColumn("h", F.xxhash64("x"))
    lengths = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())  # one, in a table of one model's vectors
    parts = [_of_length(rows.where(F.size("x") == d), d, k) for d in lengths]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = union_all(parts)
    # A query's own row has its id and, as score, the vector's squared length. Rows like that are equal in the result, so it
    # doesn't matter which one goes, as long as it is one.
    own = (F.col("id") == F.col("query_id")) & (F.col("score") == _squared("x"))
    order = Window.partitionBy("query_id", "h", "x").orderBy(F.desc("score"), "id")
    passed = F.sum(own.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = found.select("query_id", F.col("id").alias("vec_id"), "score", (own & (passed == 1)).alias("own"), (F.row_number().over(order) - F.least(passed, F.lit(1))).cast("int").alias("rank"))
    return ranked.where(~F.col("own") & (F.col("rank") <= k)).select("query_id", "rank", "vec_id", "score")
