"""Queries cover whole streams: brute force over all events of the small tables."""

import math

import pytest

import __spark_entry__ as entry
from proxjoin.streaming.counted import near_combinations

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    rows = spark.read.parquet(f"{FOLDER}/events.parquet").orderBy("event_id").collect()
    return [(f"s{r.event_id % 3}", [float(r.user_id), r.value]) for r in rows]


def test_cosine_join_is_brute_force_over_all_events(spark, events):
    sides = [[(x, y, math.hypot(x, y)) for s, (x, y) in events if s == name] for name in ("s0", "s1")]
    want = sum(1 - max(0.0, (a[0] * b[0] + a[1] * b[1]) / (a[2] * b[2])) <= 0.0001 for a in sides[0] for b in sides[1] if a[2] and b[2])
    assert entry.queries()["cosine_join_2d"](spark, FOLDER).first().n == want


def test_count_window_is_brute_force_over_all_events(spark, events):
    window = [(s, p, p[1]) for s, p in events[-300:]]
    made = [c for k, new in enumerate(window) for c in near_combinations(new, window[:k], ["s0", "s1", "s2"], 5.0)]
    got = entry.queries()["stream_count_window"](spark, FOLDER).first()
    assert (got["count"], got["sum"]) == (len(made), pytest.approx(sum(m[2] for c in made for m in c if m[0] == "s0"), abs=0.006))


def test_area_fraction_measures_all_streams(spark, events):
    q = entry.queries()
    got = q["area_fraction"](spark, FOLDER)
    assert got.count() == q["grid_replicas"](spark, FOLDER).count()
    assert {r.s for r in got.selectExpr("tupleId % 3 AS s").distinct().collect()} == {0, 1, 2}
