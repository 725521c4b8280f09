"""Groups by sketches: none above the threshold is lost, estimates bound the truth, thresholds that can't be held fail."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proxjoin.operators import groups, sketch

SCHEMA = "s1__user string, s0__v double, s1__kind string"


def made(n: int = 6000) -> list[tuple]:
    rnd = random.Random(2)
    return [(f"u{int(rnd.paretovariate(0.7)) % 900}", float(rnd.randrange(9)), None if rnd.random() < 0.1 else rnd.choice("ab")) for _ in range(n)]


@pytest.mark.parametrize("capacity", [60, 4096])
def test_no_frequent_group_is_lost(spark, capacity):
    rows = made()
    wide = spark.createDataFrame(rows, SCHEMA).repartition(5)
    counts, sums = Counter(), Counter()
    for u, v, k in rows:
        key = f"s1.user={u}&s1.kind={'null' if k is None else k}"
        counts[key] += 1
        sums[key] += v
    more_than = len(rows) / (capacity + 1) + 1 if capacity < 100 else 5
    got = {r.key: r for r in groups.grouped_by_sketch(wide, "s0", [("s1", "user"), ("s1", "kind")], ["v"], more_than, 1e-3, 0.95, capacity).collect()}
    above = {k for k, n in counts.items() if n > more_than}
    assert above and above <= set(got)
    for key, r in got.items():
        assert r["avg"] == pytest.approx(r["sum"] / r["count"])
        assert r["count"] >= counts[key] and r["sum"] >= sums[key] - 1e-6 and r["count"] <= counts[key] + 0.01 * len(rows)


def test_a_threshold_below_the_candidates_reach_fails(spark):
    wide = spark.createDataFrame(made(), SCHEMA)
    with pytest.raises(Exception, match="may not be among"):
        groups.grouped_by_sketch(wide, "s0", [("s1", "user")], ["v"], 5, capacity=60).collect()
    with pytest.raises(Exception, match="values from 0"):
        groups.grouped_by_sketch(wide.withColumn("s0__v", -F.col("s0__v")), "s0", [("s1", "user")], ["v"], 500).collect()


def test_size_and_empty(spark):
    assert groups.size(0.01, 0.95) == (272, 3)
    with pytest.raises(ValueError):
        groups.size(0, 0.5)
    out = groups.grouped_by_sketch(spark.createDataFrame([], SCHEMA), "s0", [("s1", "user")], ["v"], 5)
    assert out.columns == ["key", "count", "sum", "avg"] and out.count() == 0


def test_sketches_shuffle_no_keys(spark):
    frame = spark.range(1000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    plan = sketch.create(frame, F.col("key"), buckets=50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(row" in plan
    assert sketch.total(sketch.create(frame, F.col("key"), buckets=50)).first().n == 1000
