"""Copies are never sent to the driver, however small Spark takes them for."""

import pytest
from pyspark.sql import functions as F

from proxjoin.operators import join, window


def streams(spark, n=60):
    rows = spark.range(n).select(F.col("id").alias("tupleId"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"), F.col("id").alias("seq"))
    return {s: rows.where(F.col("tupleId") % 3 == k) for k, s in enumerate(("s0", "s1", "s2"))}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", [{}, {"salt": 4}, {"r_min": 0.5}])
def test_copies_of_cells(spark, how):
    assert "BroadcastHashJoin" not in plan(join.clique_join(streams(spark), ["x", "y"], 1.0, **how))


def test_windows_and_unjoined(spark):
    s = streams(spark)
    assert "BroadcastHashJoin" not in plan(window.window_join(s, ["x", "y"], 1.0, 20))
    assert "BroadcastHashJoin" not in plan(join.unjoined(s, join.clique_join(s, ["x", "y"], 0.5)))
    assert "BroadcastHashJoin" not in plan(join.cell_only_join(s, ["x", "y"], 1.0))
