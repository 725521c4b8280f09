"""Exact search by pivots and annuli against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxjoin.llm import annuli

SCHEMA = "vec_id long, embedding array<float>, rank string, score double"


def whole(v) -> tuple[int, ...]:
    return tuple(math.floor(256 * float(np.float32(c))) for c in v)


def brute(rows, k: int) -> list[tuple]:
    able = sorted({(i, whole(v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and sum(math.floor(256 * float(np.float32(c))) ** 2 for c in v) < 2**62})
    out = []
    for q, x in able:
        if q % 5 == 0:
            near = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in able if (i, y) != (q, x) and len(y) == len(x))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def found(frame, k: int) -> list[tuple]:
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in annuli.top_k(frame, F.col("vec_id") % 5 == 0, k).collect())


def clustered(m: int = 400, d: int = 6) -> list:
    rnd = np.random.default_rng(11)
    centres = rnd.normal(size=(8, d)) * 4
    x = (centres[rnd.integers(0, 8, m)] + rnd.normal(size=(m, d)) * 0.1).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("k", [1, 5, 30])
def test_against_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(annuli, "BLOCK", 16)
    monkeypatch.setattr(annuli, "PER_PIVOT", 20)
    rows = clustered()
    rows += [(1000 + i, rows[3][1]) for i in range(250)]  # many copies of one vector
    rows += [(2000 + i, [float(i % 2)] * 6) for i in range(40)]  # ties, zero vectors
    rows += [(3000, None), (3005, []), (3010, [1.0] * 5 + [None]), (3015, [float("nan")] * 6), (3020, [float("-inf")] * 6), (3025, [1e30] * 6), (None, [1.0] * 6)]
    rows += [(3030, [1.0, 2.0]), (3035, [2.0, 1.0]), (3040, [3.0] * 9)]  # other lengths; the last is alone
    rows += [(5, rows[5][1]), (10, [0.5] * 6), (15, rows[20][1])]  # a repeated row, ids with several vectors
    frame = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], SCHEMA).repartition(4)
    assert found(frame, k) == brute(rows, k)


def test_annuli_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(annuli, "BLOCK", 16)
    monkeypatch.setattr(annuli, "PER_PIVOT", 20)
    compared, tiles = annuli.compared, []

    def counted(frame, *more):
        tiles.append(frame.select(F.sum(F.size("q")).alias("n")).first().n)
        return compared(frame, *more)

    monkeypatch.setattr(annuli, "compared", counted)
    rows = clustered()
    frame = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], SCHEMA)
    assert found(frame, 5) == brute(rows, 5)
    queries, least_annuli = 80, 400 // 16
    assert len(tiles) >= 2 and sum(tiles) < 0.6 * queries * least_annuli


def test_large_numbers_are_exact(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, (rnd.normal(size=4) * 1e6).astype(np.float32).tolist()) for i in range(60)]
    assert max(s for *_, s in brute(rows, 3)) > 2**53
    assert found(spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], SCHEMA), 3) == brute(rows, 3)


def test_bounds_hold():
    rnd = np.random.default_rng(9)
    x = rnd.integers(-400, 400, (500, 5))
    largest = int((x * x).sum(axis=1).max())
    space = annuli.Space(largest, annuli.pick_pivots(x[:100], largest, 7))
    near = space.to_pivots(x, space.lifted(x))
    for q in x[:50]:
        to = space.to_pivots(q[None], np.zeros(1))
        for j in range(7):
            top = annuli.bounds(space, to, np.array([float(q @ q)]), np.full(500, j), near[:, j], near[:, j])
            assert (x @ q <= top[0]).all()


def test_no_queries_and_empty(spark):
    frame = spark.createDataFrame([(1, [1.0], "x", 1.0), (2, [2.0], "x", 1.0)], SCHEMA)
    assert found(frame, 5) == [] and found(frame.limit(0), 5) == []
    assert found(spark.createDataFrame([(5, [1.0], "x", 1.0)], SCHEMA), 5) == []
