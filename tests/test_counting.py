"""Counts without combinations against the nested-loop join."""

import random

import pytest
from pyspark.sql import functions as F

from proxjoin.operators import counting
from proxjoin.operators.aggregate import totals
from proxjoin.operators.join import nested_loop_join

SCHEMA = "tupleId long, x double, y double, v double"


def made(n: int, seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    out = [(i, rnd.gauss(0, 6), rnd.gauss(0, 6), float(rnd.randrange(9))) for i in range(n)]
    out += [(n + i, 1.0, -2.0, 3.0) for i in range(n // 3)]  # a crowded point
    out += [(2 * n + i, float(i % 7) * 3, 4.0, None) for i in range(21)]  # exact distances of 3
    return out + [(9000, None, 1.0, 1.0), (9001, float("inf"), 1.0, 1.0), (9002, float("nan"), 1.0, 1.0), (9003, 0.0, 0.0, 1.0), (9004, 1e300, 1.0, 2.0), (9005, 1e300, 1.0, 2.0)]


@pytest.mark.parametrize(("kind", "radius"), [("euclidean", 3.0), ("euclidean", 0.2), ("cosine", 0.02)])
@pytest.mark.parametrize("n", [2, 3])
@pytest.mark.parametrize("part", [8192, 10])
def test_same_totals_as_the_join(spark, monkeypatch, kind, radius, n, part):
    if part == 10 and radius != 3.0:
        pytest.skip("parts are tried at one radius")
    monkeypatch.setattr(counting, "PART", part)
    monkeypatch.setattr(counting, "RUN", 8)
    size = 90 if n == 3 else 200
    streams = {f"s{k}": spark.createDataFrame(made(size, k), SCHEMA) for k in range(n)}
    finite = {s: df.where("abs(x) < 1e200") for s, df in streams.items()}
    stream = f"s{n - 1}"
    want = totals(nested_loop_join(finite, ["x", "y"], radius, kind), stream, ["v", "x"], "q").first()
    far = 0 if kind == "cosine" else totals(nested_loop_join({s: df.where("x = 1e300") for s, df in streams.items()}, ["x", "y"], radius, kind)).first()["count"]
    got = counting.clique_totals(streams if kind == "euclidean" else finite, ["x", "y"], radius, kind, stream, ["v", "x"], "q").first()
    assert want["count"] > 50 and got["count"] == want["count"] + far
    if not far:
        assert got["sum_x"] == pytest.approx(want["sum_x"])
    assert got["sum"] - far * 2.0 == pytest.approx(want["sum"])


def test_groups_are_bounded_at_a_crowded_point(spark, monkeypatch):
    monkeypatch.setattr(counting, "PART", 50)
    rows = [(i, 1.0, 1.0, 1.0) for i in range(2000)]
    streams = {s: spark.createDataFrame(rows, SCHEMA) for s in ("a", "b")}
    seen = spark.sparkContext.accumulator(0)
    inner = counting.count_pairs

    def watched(a, b, *more):
        seen.add(max(len(a.place), len(b.place)) > 4 * 50)
        return inner(a, b, *more)

    monkeypatch.setattr(counting, "count_pairs", watched)
    assert counting.clique_totals(streams, ["x", "y"], 1.0).first()["count"] == 4_000_000
    assert seen.value == 0


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, 1.0, 1.0, 1.0)], SCHEMA)
    assert tuple(counting.clique_totals({"a": some, "b": none}, ["x", "y"], 1.0, stream="a", fields=["v"]).first()) == (0, 0.0, 0.0)
    assert counting.clique_totals({"a": some, "b": some, "c": some, "d": some}, ["x", "y"], 1.0).select(F.col("count")).first()[0] == 1
