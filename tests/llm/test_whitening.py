"""Whitening against numpy on the distinct vectors, with exact sums."""

import math
from fractions import Fraction

import numpy as np
import pytest

from proxjoin.llm import whitening
from proxjoin.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, component string, x double"


def whole(v) -> tuple[int, ...]:
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)


def expected(vectors: list, k: int = 16):
    distinct = sorted({whole(v) for v in vectors})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for x in distinct])
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:k]
    deviation = {x: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in distinct}
    return n, sums, e[order], axes[:, order], sum(deviation.values()) / n**3, deviation


def check(rows, vectors, k):
    n, sums, e, axes, total, deviation = expected([v for _, v in vectors], k)
    by: dict = {}
    for r in rows:
        by.setdefault(r.vec_id, []).append(r)
    for i, v in vectors:
        got = sorted(by[i], key=lambda r: r.component)
        x = whole(v)
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])
        assert {r.n for r in got} == {n} and {int(r.deviation) for r in got} == {deviation[x]}
        for r in got:
            c = r.component - 1
            assert abs(abs(r.whitened) - abs(centred @ axes[:, c] / math.sqrt(e[c]))) < 1e-7
            assert abs(r.explained - e[c] / total) < 1e-10 and r.identity_error < 1e-8
    return by


def made(seed: int = 3, m: int = 80, d: int = 20) -> list:
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(m, d)) * np.linspace(3, 0.2, d)
    x[m // 2 : m // 2 + m // 3] = x[1]  # a third of all rows
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


def test_whitened(spark):
    good = made()
    bad = [(900, None), (901, []), (902, [1.0] * 19 + [None]), (903, [float("nan")] * 20), (904, [float("inf")] * 20), (905, [1e30] * 20)]
    frame = spark.createDataFrame([(i, v, "x", 1.0) for i, v in good + bad], SCHEMA).repartition(5)
    rows = whitening.whiten(frame).collect()
    by = check(rows, good, 16)
    assert set(by) == {i for i, _ in good} and all(sorted(r.component for r in found) == list(range(1, 17)) for found in by.values())
    signs = {r.component: r.whitened for r in by[0]}
    assert all(abs(signs[r.component] - r.whitened) < 1e-12 for r in whitening.whiten(frame.repartition(2)).where("vec_id = 0").collect())


def test_whitened_covariance_is_the_identity(spark):
    rows = whitening.whiten(spark.createDataFrame([(i, v, "x", 1.0) for i, v in made(5, 60, 8)], SCHEMA)).toPandas()
    w = rows.pivot(index="vec_id", columns="component", values="whitened")
    w = w.loc[~w.duplicated()].to_numpy()
    assert np.abs(w.T @ w / len(w) - np.eye(8)).max() < 1e-9 and np.abs(w.mean(axis=0)).max() < 1e-9


def test_equal_rows_get_equal_numbers_wherever_they_stand():
    rnd = np.random.default_rng(9)
    for d, k in ((8, 8), (20, 16), (64, 16)):
        x, axes = rnd.normal(size=(257, d)), rnd.normal(size=(d, k))
        x[3::5] = x[1]
        alone = whitening.projected(x[1:2], axes)
        assert (whitening.projected(x, axes)[3::5] == alone).all()
        assert np.abs(whitening.projected(x, axes) - x @ axes).max() < 1e-12


def test_lengths_ranks_and_repeats(spark):
    flat = [(i, [float(i), float(i), 2.0, 0.0]) for i in range(6)]  # one direction only
    other = [(100 + i, v) for i, v in made(7, 12, 3)]
    lone = [(200, [5.0] * 7), (201, [5.0] * 7)]
    rows = [(i, v, "x", 1.0) for i, v in flat + other + lone]
    rows += [(0, flat[0][1], "y", 2.0), (None, flat[3][1], "x", 1.0)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id for r in got} == {None, *range(6), *range(100, 112)}
    assert {r.component for r in got if r.vec_id in range(6)} == {1} and sum(r.vec_id == 0 for r in got) == 2
    check([r for r in got if r.vec_id is not None and r.vec_id >= 100], other, 3)
    assert all(abs(r.explained - 1) < 1e-12 for r in got if r.vec_id in range(6))
    assert next(r.whitened for r in got if r.vec_id is None) == next(r.whitened for r in got if r.vec_id == 3)


def test_empty(spark):
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0


@pytest.mark.parametrize("scale", [1, 10**9, 10**13])
def test_deviations_are_exact(scale):
    x = np.array([[scale, -3], [5, scale]], dtype=np.int64)
    n, s = 7 * scale, np.array([scale**2, 11], dtype=object)
    apart = [[n * int(a) - int(b) for a, b in zip(r, s, strict=True)] for r in x]
    found = whitening.deviations(x, n, s)
    assert found.tolist() == apart and whitening.squared_lengths(found) == [sum(a * a for a in r) for r in apart]


def test_registered_query_over_the_table(spark):
    folder = "/root/testdata/sf0.001"
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    table = [(i, v) for i, v in table if v and all(c is not None and math.isfinite(c) for c in v)]
    frame = QUERIES["op11_whitening"](spark, folder)
    assert dict(frame.dtypes)["deviation"] == "bigint"
    assert set(check(frame.collect(), table, 16)) == {i for i, _ in table}
