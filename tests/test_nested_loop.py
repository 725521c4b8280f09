"""The nested loop's comparisons are dealt to all cores, though a small table is one part of a file."""

import random

import __spark_entry__ as entry
from proxjoin.operators import join

FOLDER = "/root/testdata/sf0.001"


def test_all_pairs_are_compared_by_many_tasks(spark):
    assert spark.read.parquet(f"{FOLDER}/events.parquet").rdd.getNumPartitions() == 1
    joined = entry.queries()["clique3_nested_loop"](spark, FOLDER)
    assert joined.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_blocks_are_compared_before_rows(spark, monkeypatch):
    """Blocks of four rows: odd places, equal rows in many blocks, pairs exactly a radius apart, and all combinations."""
    monkeypatch.setattr(join, "RUN", 2)
    rnd = random.Random(3)
    odd = [(None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (1e300, 1.0), (1e300, 1.0), (-0.0, 0.0)]
    places = [(rnd.randrange(40) / 4, rnd.randrange(40) / 4) for _ in range(150)] + [(5.0, 5.0)] * 30 + odd
    rows = [(i, s, x, y) for i, (x, y) in enumerate(places) for s in ("a", "b", "c") if rnd.random() < 0.6]
    table = spark.createDataFrame(rows, "tupleId long, s string, x double, y double")
    streams = {s: table.where(f"s = '{s}'").drop("s") for s in ("a", "b", "c")}
    finite = {s: df.where("abs(x) < double('inf')") for s, df in streams.items()}
    for radius in (0.25, 1.0):
        ids = lambda wide: sorted((r.a__tupleId, r.b__tupleId, r.c__tupleId) for r in wide.collect())
        want = ids(join.nested_loop_join(finite, ["x", "y"], radius))
        assert len(want) > 1000 and ids(join.block_nested_loop_join(streams, ["x", "y"], radius)) == want


def test_rows_far_apart_are_not_compared(spark):
    """300,000 rows of a stream on a line, each with one partner: 90,000,000,000 pairs."""
    a = spark.range(300_000).selectExpr("id AS tupleId", "DOUBLE(id) AS x", "0.0D AS y")
    joined = join.block_nested_loop_join({"a": a, "b": a.withColumn("x", a.x + 0.4)}, ["x", "y"], 0.5)
    assert joined.count() == 300_000
