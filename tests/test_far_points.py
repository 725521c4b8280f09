"""Joins of points that are infinite, very large, or far from the origin."""

import numpy as np
import pytest

from proxjoin.operators.join import array_pairs, clique_join, nested_loop_join
from proxjoin.operators.window import window_join

SCHEMA = "tupleId long, x double, y double, seq long"


def made(spark, k):
    inf, nan = float("inf"), float("nan")
    rows = [(0.0, 0.0), (1.0, 1.0), (inf, 0.0), (-inf, 0.0), (nan, 0.0), (0.0, inf), (1e300, 1.0), (1e300, 1.0), (-1e300, 1.0), (9e18, 0.5), (9.3e18, 0.5), (1e19, -0.5), (None, 1.0)]
    return spark.createDataFrame([(100 * k + i, x, y, i) for i, (x, y) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(("kind", "radius"), [("euclidean", 2.0), ("euclidean", 0.001), ("cosine", 0.1)])
def test_rows_that_no_cell_holds(spark, kind, radius):
    streams = {"a": made(spark, 1), "b": made(spark, 2)}
    ids = lambda wide: sorted(r.joinId for r in wide.select("joinId").collect())
    want = ids(nested_loop_join(streams, ["x", "y"], radius, kind))
    assert len(want) > 3 and ids(clique_join(streams, ["x", "y"], radius, kind)) == want
    assert ids(window_join(streams, ["x", "y"], radius, 100, kind)) == want


def test_vectors_far_from_the_origin(spark):
    rnd = np.random.default_rng(1)
    x = 1e6 + rnd.normal(size=(60, 4)) * 3e-4
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    want = {(i, j): float(np.sqrt(((x[i] - x[j]) ** 2).sum())) for i in range(60) for j in range(i + 1, 60)}
    want = {k: d for k, d in want.items() if d <= 8e-4}
    got = {(r.id_a, r.id_b): r.distance for r in array_pairs(frame, "v", 8e-4, kind="euclidean", block=16).collect()}
    assert 100 < len(want) < 1770 and got == pytest.approx(want, rel=1e-12)
