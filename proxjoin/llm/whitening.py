"""Whitening of embeddings: principal components of the distinct vectors, each with variance 1.

Entries become whole numbers first, so sums and deviations are exact. The fit list (each distinct vector once) is stored,
summed by dimension, centred row by row and handed to MLlib's ``RowMatrix.computeSVD`` as distributed rows; singular
values are rescaled by the divisor n, so a component's variance is s^2 / n. All of the dimensions are asked for, as MLlib
then decomposes the Gram matrix densely, to double precision, and not by an iteration that stops at a tolerance. The
total variance doesn't come from the decomposition: it adds up the rows' exact deviations. The driver holds d x d numbers
for vectors of d entries, whatever the number of rows; MLlib does so for up to 15,000 entries.

Defined results: a row whose vector is null, empty or holds an entry that is null, not finite, or too large for a whole
number of 64 bits takes no part and gets no row. Vectors of different lengths are whitened apart, each length by its own
fit list. Repeated rows and rows without an id get their rows each, by the fit of distinct vectors. Components whose
variance is within rounding of nothing (1e-12 of the largest) are left out, so a fit list of one vector gives no rows, nor
does an empty table. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxjoin.llm.common import materialize, union_all

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond it have no whole number of 64 bits.
LARGEST = 2.0**56
#: Components with less of the largest variance are rounding.
NOTHING = 1e-12


@dataclass(frozen=True)
class Fit:
    """What whitens vectors of one length: n and S of the fit list, projections (a column for each component), variances."""

    n: int
    sums: tuple[int, ...]
    projections: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float


def usable(vector: Column) -> Column:
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST)
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: by 64-bit numbers where they hold it, else by Python's."""
    room = 2**63 - 1
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums.tolist())) > room:
        return n * x.astype(object) - sums.astype(object)
    return n * x - sums.astype(np.int64)


def squared_lengths(apart: np.ndarray) -> list[int]:
    """Sums of squares of rows, exactly."""
    most = max(abs(int(apart.max(initial=0))), abs(int(apart.min(initial=0))))
    if apart.dtype == object or most * most * apart.shape[1] > 2**63 - 1:
        apart = apart.astype(object)
    return [int(s) for s in (apart * apart).sum(axis=1)]


def _sums(fit_list: DataFrame) -> tuple[int, tuple[int, ...]]:
    """n and S: each partition adds up its rows, so (partitions x dimensions) numbers are shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if len(batch):
                part = matrix(batch).sum(axis=0, dtype=object)
                n, total = n + len(batch), part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_pydict({"at": list(range(-1, len(total))), "s": [str(v) for v in (n, *total)]})

    parts = fit_list.mapInArrow(add, "at long, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by = {r["at"]: int(r["s"]) for r in parts.collect()}  # a row for each dimension
    return by.pop(-1, 0), tuple(by[i] for i in sorted(by))


def _total_variance(fit_list: DataFrame, n: int, sums: tuple[int, ...]) -> float:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(sums, dtype=object)
        total = sum(sum(squared_lengths(deviations(matrix(b), n, s))) for b in batches)
        yield pa.RecordBatch.from_pydict({"v": [total / n**3]})

    return fit_list.mapInArrow(add, "v double").agg(F.sum("v")).first()[0]


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return (deviations(x, n, np.array(sums, dtype=object)) / n).astype(np.float64)


def projected(centred: np.ndarray, projections: np.ndarray) -> np.ndarray:
    """The product, added up entry by entry: a matrix product rounds a row by its place in the batch, and equal rows get
    equal numbers here.
    """
    out = np.zeros((len(centred), projections.shape[1]))
    for j in range(projections.shape[0]):
        out += centred[:, j, None] * projections[j]
    return out


def _identity_error(fit_list: DataFrame, n: int, sums: tuple[int, ...], projections: np.ndarray) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity, from sums by partition."""
    k = projections.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = projected(_centred(matrix(batch), n, sums), projections)
            total, mean = total + w.T @ w, mean + w.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": list(range(k * k + k)), "v": [*total.ravel().tolist(), *mean.tolist()]})

    found = {r["at"]: r["v"] / n for r in fit_list.mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}  # k x (k + 1) rows
    flat = np.array([found[i] for i in range(k * k + k)])
    mean = flat[k * k :]
    return float(np.abs(flat[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def fit(fit_list: DataFrame, components: int = 16) -> Fit | None:
    """The whitening of a stored table of distinct whole-number vectors ``x`` of one length; None if nothing varies."""
    n, sums = _sums(fit_list)
    if n < 2:
        return None
    d = len(sums)

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _centred(matrix(batch), n, sums)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), d).cast(pa.list_(pa.float64()))], ["c"])

    rows = fit_list.mapInArrow(centre, "c array<double>").select(array_to_vector("c").alias("c"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "c"), n, d).computeSVD(d)
    variances = np.array(svd.s.toArray()) ** 2 / n
    kept = int((variances[:components] > NOTHING * variances[0]).sum())
    axes = svd.V.toArray()[:, :kept]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    projections = axes / np.sqrt(variances[:kept])
    return Fit(n, sums, projections, variances[:kept], _total_variance(fit_list, n, sums), _identity_error(fit_list, n, sums, projections))


def project(rows: DataFrame, key: str, fitted: Fit) -> DataFrame:
    """A row for each of ``rows`` (key, x) and component."""
    kind = rows.schema[key].dataType
    k = len(fitted.variances)
    explained = (fitted.variances / fitted.total).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(fitted.sums, dtype=object)
        for batch in batches:
            apart = deviations(matrix(batch), fitted.n, s)
            white = projected((apart / fitted.n).astype(np.float64), fitted.projections)
            m = len(batch)
            lengths = pa.array([str(v) for v in squared_lengths(apart)])
            repeat = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), lengths.take(repeat), pa.array(white.ravel()), pa.array(np.tile(explained, m))],
                [key, "component", "deviation", "whitened", "explained"],
            )

    out = rows.mapInArrow(run, f"`{key}` {kind.simpleString()}, component int, deviation string, whitened double, explained double")
    return out.select(key, "component", F.lit(fitted.n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", F.lit(fitted.identity_error).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable row; deviation is decimal(38,0)."""
    rows = vectors.where(usable(F.col(vector))).select(key, whole(F.col(vector)).alias("x"))
    fit_list = materialize(rows.select("x").distinct())
    lengths = sorted(r[0] for r in fit_list.select(F.size("x")).distinct().collect())  # one, in a table of one model's vectors
    parts = []
    for d in lengths:
        fitted = fit(fit_list.where(F.size("x") == d), components)
        if fitted:
            parts.append(project(rows.where(F.size("x") == d), key, fitted))
    if parts:
        return union_all(parts)
    kind = vectors.schema[key].dataType.simpleString()
    return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
