"""Pairs of vectors by pivots against brute force, and how much is left out."""

import numpy as np
import pytest

from proxjoin.operators.join import array_pairs
from proxjoin.operators.near import NearPairs, near_pairs

SCHEMA = "id long, v array<double>"


def clustered(n=240, groups=8, size=12, spread=0.05):
    rnd = np.random.default_rng(7)
    centres = rnd.normal(size=(groups, size))
    return [(k, (centres[k % groups] + spread * rnd.normal(size=size)).tolist()) for k in range(n)]


def brute(rows, radius, kind):
    out = {}
    for k, (a, x) in enumerate(rows):
        for b, y in rows[k + 1 :]:
            x, y = np.array(x), np.array(y)
            if kind == "cosine" and not (x.any() and y.any()):
                continue
            d = float(1 - max(0.0, x @ y / np.sqrt((x @ x) * (y @ y)))) if kind == "cosine" else float(np.sqrt(((x - y) ** 2).sum()))
            if d <= radius:
                out[min(a, b), max(a, b)] = d
    return out


@pytest.mark.parametrize(("kind", "radius", "block"), [("cosine", 0.004, 1024), ("cosine", 0.3, 16), ("euclidean", 0.2, 1024)])
def test_pairs_are_brute_force(spark, kind, radius, block):
    rows = [*clustered(120), (500, [0.0] * 12), (501, [1e-9] * 12), (502, [1e6] * 12), (503, [1e6] * 12)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.id_a, r.id_b): r.distance for r in near_pairs(frame, "v", radius, kind=kind, pivots=6, block=block).collect()}
    want = brute(rows, radius, kind)
    assert len(want) > 20 and got == pytest.approx(want, abs=1e-12)


def test_small_radii_leave_out_most_pairs(spark):
    frame = spark.createDataFrame(clustered(), SCHEMA)
    near = NearPairs(frame, "v", 0.002)
    share = near.share().first()
    assert share.pairs == 240 * 239 // 2 and share.skipped > 0.8
    want = {(r.id_a, r.id_b) for r in array_pairs(frame, "v", 0.002).collect()}
    assert len(want) > 20 and {(r.id_a, r.id_b) for r in near.pairs().collect()} == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.id_a, r.id_b, r.distance) for r in near_pairs(frame, "v", 0.0).collect())
    assert got == [(1, 2, 0.0), (1, 2, 0.0)]
    assert near_pairs(frame, "v", 0.0, kind="euclidean").count() == 1
    assert near_pairs(frame.limit(0), "v", 0.5).count() == 0
    assert NearPairs(frame.limit(0), "v", 0.5).share().first().skipped is None
    for bad in ({"kind": "blocks", "radius": 1.0}, {"radius": 1.0}, {"radius": -0.1}):
        with pytest.raises(ValueError):
            near_pairs(frame, "v", **bad)
