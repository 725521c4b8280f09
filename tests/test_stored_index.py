"""The stored index against all pairs: joins, searches, versions, and row groups that are skipped."""

import random

import pytest
from pyspark.sql import functions as F

from proxjoin.operators.index import StoredIndex
from proxjoin.operators.join import nested_loop_join

SCHEMA = "tupleId long, x double, y double"
CENTROIDS = [[0.0, 0.0], [20.0, 0.0], [0.0, 20.0]]


def made(spark, n, seed):
    rnd = random.Random(seed)
    rows = [(1000 * seed + i, rnd.uniform(-5, 25), rnd.uniform(-5, 25)) for i in range(n)]
    rows += [(1000 * seed + 900 + i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (20.0, 0.0), (10.0, 0.0), (None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0)])]
    return spark.createDataFrame(rows, SCHEMA)


def ids(wide):
    return sorted(r.joinId for r in wide.select("joinId").collect())


@pytest.mark.parametrize(("kind", "radius"), [("euclidean", 2.0), ("euclidean", 40.0), ("cosine", 0.001)])
def test_join(spark, tmp_path, kind, radius):
    probes, rows = made(spark, 120, 1), made(spark, 150, 2)
    centroids = [[1.0, 0.0], [0.6, 0.8]] if kind == "cosine" else CENTROIDS
    stored = StoredIndex(spark, str(tmp_path / "index"), ["x", "y"], centroids, kind)
    stored.insert(rows)
    finite = [df.where("abs(x) < 1e300") for df in (probes, rows)]
    want = ids(nested_loop_join(dict(zip(("a", "b"), finite, strict=True)), ["x", "y"], radius, kind))
    assert len(want) > 20 and ids(stored.join(probes, radius)) == want


def test_versions_and_searches(spark, tmp_path):
    rows = made(spark, 200, 1)
    stored = StoredIndex(spark, str(tmp_path / "index"), ["x", "y"], CENTROIDS)
    stored.insert(rows)
    held = {r.tupleId: (r.x, r.y) for r in rows.where("abs(x) < 1e300").collect()}
    near = lambda p, r: sorted(i for i, (x, y) in held.items() if ((x - p[0]) ** 2 + (y - p[1]) ** 2) ** 0.5 <= r)
    found = lambda p, r: sorted(x.tupleId for x in stored.near(p, r).collect())
    for p, r in (((3.0, 4.0), 6.0), ((20.0, 0.0), 0.0), ((500.0, 500.0), 1.0)):
        assert found(p, r) == near(p, r)
    gone = rows.where("tupleId % 3 = 0")
    stored.delete(gone)
    stored.insert(gone.where("tupleId % 2 = 0"))
    stored.insert(rows.where("tupleId = 1001"))  # kept twice
    held = {i: v for i, v in held.items() if i % 3 or i % 2 == 0}
    assert sorted(r.tupleId for r in stored.rows().collect()) == sorted([*held, 1001])
    assert found((3.0, 4.0), 6.0) == sorted(near((3.0, 4.0), 6.0) + [1001] * (1001 in near((3.0, 4.0), 6.0)))
    keys = {r.tupleId: r.key for r in stored.keyed(rows).collect()}
    low, high = sorted(keys.values())[20], sorted(keys.values())[60]
    for include, inside in (("both", lambda k: low <= k <= high), ("none", lambda k: low < k < high), ("low", lambda k: low <= k < high)):
        assert {r.tupleId for r in stored.range(low, high, include).collect()} == {i for i in held if inside(keys[i])}
    with pytest.raises(ValueError, match="unknown ends"):
        stored.range(0, 1, "some")


def test_row_groups_are_skipped(spark, tmp_path):
    rows = spark.range(60_000).select(F.col("id").alias("tupleId"), (F.rand(1) * 100).alias("x"), (F.rand(2) * 100).alias("y"))
    stored = StoredIndex(spark, str(tmp_path / "index"), ["x", "y"], [[25.0, 25.0], [75.0, 75.0]], group_bytes=1 << 16)
    stored.insert(rows)

    def scanned(frame) -> int:
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan()
        todo, total = [plan], 0
        while todo:
            node = todo.pop()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                todo.append(node.executedPlan())
                continue
            if node.nodeName().startswith("Scan parquet"):
                total += node.metrics().apply("numOutputRows").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        return total

    assert scanned(stored.rows()) == 60_000
    assert scanned(stored.near([25.0, 25.0], 2.0)) < 20_000
    assert "PushedFilters: [" in stored.range(0.0, 3.0)._jdf.queryExecution().toString() and scanned(stored.range(0.0, 3.0)) < 20_000


def test_odd_input(spark, tmp_path):
    empty = StoredIndex(spark, str(tmp_path / "empty"), ["x", "y"], CENTROIDS)
    empty.insert(spark.createDataFrame([], SCHEMA))
    assert empty.near([0.0, 0.0], 5.0).count() == 0 and empty.join(made(spark, 5, 1), 5.0).count() == 0
    far = StoredIndex(spark, str(tmp_path / "far"), ["x", "y"], CENTROIDS)
    with pytest.raises(Exception, match="farther than"):
        far.insert(spark.createDataFrame([(1, 1e7, 0.0)], SCHEMA))
    with pytest.raises(ValueError):
        far.join(made(spark, 5, 1), 0)
