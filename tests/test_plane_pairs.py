"""Pairs within a cosine radius in the plane, counted by ranges of angles, against all pairs."""

import math
import random

import pytest

from proxjoin.operators import counting

SCHEMA = "tupleId long, x double, y double"


def brute(a: list[tuple], b: list[tuple], radius: float) -> int:
    some = [[(x, y) for _, x, y in rows if x * x + y * y > 0] for rows in (a, b)]
    far = lambda p, q: 1 - max(0.0, (p[0] * q[0] + p[1] * q[1]) / (math.sqrt(p[0] * p[0] + p[1] * p[1]) * math.sqrt(q[0] * q[0] + q[1] * q[1])))
    return sum(far(p, q) <= radius for p in some[0] for q in some[1])


@pytest.mark.parametrize("radius", [1e-15, 1e-4, 0.02, 1 - math.cos(math.pi / 4), 0.5, 0.999999])
def test_same_count_as_all_pairs(spark, radius):
    rnd = random.Random(7)
    made = lambda n: [(i, float(rnd.randrange(-4, 5)), float(rnd.randrange(-4, 5))) for i in range(n)] + [(n + i, rnd.gauss(0, 9), rnd.gauss(0, 9)) for i in range(n)] + [(3 * n, -1.0, 0.0), (3 * n, -1.0, -0.0), (3 * n, -5.0, 1e-9)]
    a, b = made(150), made(130)
    want = brute(a, b, radius)
    got = counting.clique_totals({"a": spark.createDataFrame(a, SCHEMA), "b": spark.createDataFrame(b, SCHEMA)}, ["x", "y"], radius, "cosine")
    assert want > 50 and got.first()["count"] == want


def test_no_group_of_rows_meets_in_a_task(spark, monkeypatch):
    # All directions lie within the radius of one another: runs of both streams met, all with all.
    monkeypatch.setattr(counting, "count_pairs", None)
    rows = spark.range(40_000).selectExpr("id AS tupleId", "1000.0D + id AS x", "double(id % 7) AS y")
    assert counting.clique_totals({"a": rows, "b": rows}, ["x", "y"], 0.01, "cosine").first()["count"] == 1_600_000_000
