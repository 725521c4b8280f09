"""What a task holds, and how often combinations are made, whatever the number of rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proxjoin.functions import geometry
from proxjoin.operators import aggregate, grid, groups


def test_shares_are_no_expression_too_large_to_compile(spark):
    df = spark.range(3).select(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("a"))
    shares = df.select(geometry.area_fraction([F.col("x"), F.col("x")], [F.col("a"), F.col("a")], 1.0, 1.0))
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and len(plan) < 2000
    assert [r[0] for r in df.select(geometry.area_fraction([F.col("x")], [F.col("a")], 1.0, 0.5)).collect()] == [0.5, 0.5, 0.0]


def test_any_threshold_has_all_of_its_groups(spark):
    """As many groups above as below, far more than rows / threshold candidates would hold."""
    rnd = random.Random(3)
    keys = [f"u{i}" for i in range(900) for _ in range(1 + rnd.randrange(4))]
    rnd.shuffle(keys)
    wide = spark.createDataFrame([(k, 1.5) for k in keys], "s1__user string, s0__v double").repartition(5)
    above = {f"s1.user={k}": n for k, n in Counter(keys).items() if n > 2}
    with pytest.raises(Exception, match="may not be among"):
        groups.grouped_by_sketch(wide, "s0", [("s1", "user")], ["v"], 2, capacity=60).collect()
    got = {r.key: r for r in groups.grouped_by_sketch(wide, "s0", [("s1", "user")], ["v"], 2, again=True).collect()}
    assert set(above) <= set(got) and all(got[k]["count"] >= n and got[k]["sum"] >= 1.5 * n for k, n in above.items())
    assert groups.grouped_by_sketch(wide.limit(0), "s0", [("s1", "user")], ["v"], 2, again=True).count() == 0


def test_running_totals_make_combinations_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    wide = spark.range(500).select(F.col("id").cast("string").alias("joinId"), F.col("id").alias("t"), F.lit(2.0).alias("s0__y"))
    wide = wide.mapInPandas(count, "joinId string, t long, s0__y double")
    got = sorted(aggregate.running(wide, F.col("t"), "s0", "y").collect(), key=lambda r: r["count"])
    assert [(r["count"], r["sum"], r["avg"]) for r in got] == [(k, 2.0 * k, 2.0) for k in range(1, 501)]
    assert made.value == 500


def test_rows_are_dealt_before_they_are_copied(spark, monkeypatch):
    monkeypatch.setattr(grid, "COUNTED", 100)
    rows = spark.range(1000).select((F.col("id") % 40).cast("double").alias("x"), (F.col("id") / 40).alias("y")).coalesce(1)
    counted = grid.copy_counts(rows, [F.col("x"), F.col("y")], 1.0, 1.0)
    assert "REPARTITION_BY_NUM" in counted._jdf.queryExecution().executedPlan().toString()
    assert grid.spread(rows, 1000).rdd.getNumPartitions() == 10
    want = grid.replicate(rows, [F.col("x"), F.col("y")], 1.0, 1.0).groupBy("cell_0", "cell_1").count()
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, want.collect()))
