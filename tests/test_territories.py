"""Joins by the territories of centroids against all pairs, in batch, by configuration and over a stream."""

import random

import pytest
from pyspark.sql import functions as F

from proxjoin.operators import voronoi, window
from proxjoin.operators.join import nested_loop_join
from proxjoin.plans.config import parse
from proxjoin.plans.engine import run
from proxjoin.streaming import numbered
from proxjoin.streaming.clustered import kmeans_window_join

SCHEMA = "tupleId string, x double, y double"


def made(spark, n, seed):
    rnd = random.Random(seed)
    rows = [(f"{seed}-{i}", rnd.choice([0.0, 20.0]) + rnd.gauss(0, 4), rnd.gauss(0, 4)) for i in range(n)]
    rows += [(f"{seed}-c{i}", 10.0, 0.0) for i in range(20)]  # on the plane between two centroids
    rows += [(f"{seed}-z", 0.0, 0.0), (f"{seed}-n", None, 1.0), (f"{seed}-i", float("inf"), 1.0), (f"{seed}-a", float("nan"), 1.0), (f"{seed}-f", 1e150, 0.0)]
    return spark.createDataFrame(rows, SCHEMA)


def ids(wide):
    return sorted(r.joinId for r in wide.select("joinId").collect())


CENTROIDS = [[0.0, 0.0], [20.0, 0.0], [20.0, 0.0], [0.0, 10.0], [-5.0, -5.0]]


@pytest.mark.parametrize(("n", "kind", "radius", "salt"), [(2, "euclidean", 2.0, 1), (2, "euclidean", 30.0, 3), (3, "euclidean", 1.5, 1), (2, "cosine", 0.01, 1), (3, "cosine", 0.001, 2)])
def test_same_combinations(spark, n, kind, radius, salt):
    streams = {f"s{k}": made(spark, 60 if n == 3 else 120, k) for k in range(n)}
    finite = {s: df.where("abs(x) < 1e300") for s, df in streams.items()}
    want = ids(nested_loop_join(finite, ["x", "y"], radius, kind))
    unit = [[1.0, 0.0], [0.0, 1.0], [-0.6, 0.8]]
    got = ids(voronoi.voronoi_join(streams, ["y", "x"], radius, unit if kind == "cosine" else CENTROIDS, kind, salt=salt))
    assert len(want) > 20 and got == want


def test_rows_of_a_territory_meet_only_in_near_cells(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("tupleId"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    wide = voronoi.voronoi_join({"a": rows, "b": rows}, ["x", "y"], 1.0, [[0.0, 0.0]])
    assert wide.count() == 2000 + 2 * 1999
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "_at_0" in plan.split("Join Inner")[1].split("\n")[0]
    same = voronoi.voronoi_join({"a": rows, "b": rows}, ["x", "y"], 0.0, [[0.0, 0.0], [900.0, 0.0]])
    assert same.count() == 2000


@pytest.mark.parametrize("few", [0, 2000])
def test_rows_of_a_place_meet_only_in_their_window(spark, monkeypatch, few):
    monkeypatch.setattr(voronoi, "FEW", few)
    rows = spark.range(40_000).selectExpr("string(id) AS tupleId", "id AS seq", "(id % 2) * 0.5D AS x", "(id % 3) * 0.3D AS y")
    wide = voronoi.voronoi_join({"a": rows, "b": rows}, ["x", "y"], 1.0, [[0.0, 0.0], [9.0, 9.0]], band=("seq", 3), distinct=True)
    keys = wide._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].split("\n")[0]
    assert "_band" in keys and ("_at_0" in keys) == (few == 0)
    assert wide.count() == 5 * 40_000 - 6


def test_one_centroid_and_few_copies(spark):
    streams = {"a": made(spark, 50, 1), "b": made(spark, 50, 2)}
    want = ids(nested_loop_join({s: df.where("abs(x) < 1e300") for s, df in streams.items()}, ["x", "y"], 1.0))
    assert ids(voronoi.voronoi_join(streams, ["x", "y"], 1.0, [[3.0, 3.0]])) == want
    assert ids(voronoi.kmeans_join(streams, ["x", "y"], 1.0, 6)) == want
    copies = made(spark, 300, 3).where("abs(x) < 1e100 AND abs(x - 10) > 2.1").select(F.size(voronoi._territories([F.col("x"), F.col("y")], [[0.0, 0.0], [20.0, 0.0]], 2.0)).alias("n"))
    assert copies.agg(F.max("n")).first()[0] == 1


def test_configuration(spark):
    raw = {
        "clustering": {"type": "kmeans", "k": 5, "iterations": 4},
        "streams": [{"id": s, "fields": [{"name": "tupleId", "type": "string"}, {"name": "x", "type": "double"}, {"name": "y", "type": "double"}]} for s in ("a", "b")],
        "queries": [{"id": "q", "stages": [{"type": "join", "between": ["a", "b"], "on": ["x", "y"], "radius": 1.0}, {"type": "count"}]}],
    }
    tables = {"a": made(spark, 40, 1), "b": made(spark, 40, 2)}
    by_clusters, by_grid = (run(parse(raw | {"clustering": c}), {s: df.where("abs(x) < 1e100") for s, df in tables.items()})["q"] for c in (raw["clustering"], {"type": "grid"}))
    assert ids(by_clusters.combinations) == ids(by_grid.combinations) and by_clusters.aggregates[0].first()["count"] > 0
    with pytest.raises(ValueError, match="unknown clustering"):
        parse(raw | {"clustering": {"type": "tree"}})
    with pytest.raises(ValueError, match="cells of a grid"):
        run(parse(raw | {"approximate": True}), tables)


def test_windows_over_a_stream(spark, tmp_path):
    rnd, at, length = random.Random(6), str(tmp_path), 30
    rows = [(f"t{i:03d}", i, f"s{rnd.randrange(3)}", rnd.uniform(0, 9), rnd.uniform(0, 9)) for i in range(150)]
    schema = "tupleId string, o long, streamId string, x double, y double"
    for part in (rows[:60], rows[60:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{at}/in")
        source = spark.readStream.schema(schema).parquet(f"{at}/in")
        numbered.number_rows(source, "o", f"{at}/log", f"{at}/numbering").awaitTermination()
        stream = numbered.numbered_stream(spark, f"{at}/log", source.schema)
        kmeans_window_join(stream, f"{at}/log", ["s0", "s1", "s2"], ["x", "y"], 2.0, length, f"{at}/rows", f"{at}/joining", 4, 3).awaitTermination()
    n = window.sequence(spark.createDataFrame(rows, schema), "o")
    want = ids(window.window_join({s: n.where(F.col("streamId") == s) for s in ("s0", "s1", "s2")}, ["x", "y"], 2.0, length))
    assert len(want) > 50 and ids(spark.read.parquet(f"{at}/rows")) == want
