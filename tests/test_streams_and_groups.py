"""No link is lost at cells' edges or in streams; streams go on after a stop; groups share one join."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from proxjoin.functions import geometry
from proxjoin.operators import cluster, join
from proxjoin.plans.config import parse
from proxjoin.plans.engine import run, run_shared
from proxjoin.plans.stream import run_stream
from proxjoin.sources import log, sinks
from proxjoin.streaming.counted import Window, near_combinations
from proxjoin.streaming.joins import event_time_join


def ids(df):
    return sorted(r.joinId for r in df.select("joinId").collect())


@pytest.mark.parametrize("radius", [2.0, 1.0, 0.1, 3.3])
@pytest.mark.parametrize("axes", [["x"], ["x", "y"]])
def test_points_on_multiples_of_the_radius(spark, radius, axes):
    rnd = random.Random(4)
    at = lambda k: math.nextafter(k * radius, rnd.choice([-math.inf, math.inf])) if rnd.random() < 0.5 else k * radius
    rows = {s: [(f"{s}{i}", at(rnd.randint(-4, 4)), at(rnd.randint(-1, 1))) for i in range(40)] for s in "ab"}
    rows["a"].append(("edge", 1.9999999999999998, 0.0))
    rows["b"].append(("near", 4.0, 0.0))
    tables = {s: spark.createDataFrame(r, "tupleId string, x double, y double") for s, r in rows.items()}
    want = ids(join.nested_loop_join(tables, axes, radius))
    assert ids(join.clique_join(tables, axes, radius)) == want and want
    if radius == 2.0:
        assert "edge-near" in want


def stream_of(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


@pytest.mark.parametrize(("kind", "radius"), [("cosine", 0.02), ("euclidean", 2.0)])
def test_streams_find_the_batch_joins_links(spark, tmp_path, kind, radius):
    rnd = random.Random(7)
    schema = "tupleId string, s string, x double, y double, ts timestamp"
    from datetime import datetime, timedelta

    rows = [(f"{i}", rnd.choice("ab"), float(rnd.randint(-4, 4)), float(rnd.randint(-4, 4)), datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(80)]
    e = stream_of(spark, str(tmp_path / "in"), rows, schema)
    parts = {s: e.where(F.col("s") == s).drop("s") for s in "ab"}
    wide = event_time_join(parts, ["x", "y"], radius, "10 hours", "1 day", kind).select("joinId")
    sinks.stream_rows(wide, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    batch = spark.read.parquet(str(tmp_path / "in"))
    tables = {s: batch.where(F.col("s") == s).drop("s", "ts") for s in "ab"}
    want = ids(join.nested_loop_join(tables, ["x", "y"], radius, kind))
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == want and want


def test_streams_without_a_grid_are_refused(spark, tmp_path):
    e = stream_of(spark, str(tmp_path / "in"), [("a", 1.0, None)], "tupleId string, x double, ts timestamp")
    for kind, radius in (("manhattan", 1.0), ("cosine", 1.0)):
        with pytest.raises(ValueError):
            event_time_join({"a": e, "b": e}, ["x"], radius, kind=kind)


def _config(radii=(2.0,), kind="euclidean"):
    fields = [{"name": n, "type": "double"} for n in ("x", "y", "v")] + [{"name": "t", "type": "string"}]
    stages = lambda r, k: [{"type": "join", "between": ["a", "b"], "on": ["x", "y"], "radius": r, "distanceType": kind}, {"type": "where", "clauses": [{"stream": "a", "field": "v", "operator": "gt", "value": k}]}, {"type": "sum", "aggregateStream": "a", "aggregatableFields": ["v"]}]
    return parse({"streams": [{"id": s, "fields": fields} for s in "ab"], "queries": [{"id": f"q{k}", "stages": stages(r, k)} for k, r in enumerate(radii)]})


def _rows(n, seed=2):
    rnd = random.Random(seed)
    return [(i, rnd.choice("abc"), rnd.uniform(-4, 4) if rnd.random() < 0.9 else None, rnd.uniform(-4, 4), float(i % 7), "t") for i in range(n)]


ROWS = "tupleId long, streamId string, x double, y double, v double, t string"


def test_a_stopped_stream_goes_on(spark, tmp_path):
    rows = _rows(120)
    for name, parts in (("once", [rows]), ("twice", [rows[:50], rows[50:]])):
        for part in parts:
            e = stream_of(spark, str(tmp_path / name / "in"), part, ROWS)
            for q in run_stream(_config(), e, str(tmp_path / name / "out"), str(tmp_path / name / "check"), window=30).values():
                q.awaitTermination()
    once, twice = (sorted(map(tuple, spark.read.parquet(str(tmp_path / n / "out" / "q0")).collect())) for n in ("once", "twice"))
    assert once == twice
    members = [r for r in rows if r[1] in "ab"]
    assert len(once) == len(members)
    window = [(s if v > 0 or s == "b" else "", [x, y] if x is not None else None, v) for _, s, x, y, v, _ in members[-30:]]
    made = [c for k, new in enumerate(window) if new[1] and new[0] for c in near_combinations(new, [w for w in window[:k] if w[1]], ["a", "b"], 2.0)]
    last = max(once, key=lambda r: r[1])
    assert last[4] == len(made) and last[5] == pytest.approx(sum(m[2] for c in made for m in c if m[0] == "a"))


@pytest.mark.parametrize("kind", ["euclidean", "cosine"])
def test_window_of_arrays_is_brute_force(kind):
    import numpy as np

    rnd = random.Random(3)
    w, held = Window(["a", "b", "c"], 1.5 if kind == "euclidean" else 0.2, 12, "a", kind, 2), []

    def near(p, q):
        if kind == "euclidean":
            return math.dist(p, q) <= 1.5
        n = math.hypot(*p) * math.hypot(*q)
        return (1 - max(0.0, (p[0] * q[0] + p[1] * q[1]) / n) if n else 1.0) <= 0.2

    def brute(new, rows):
        import itertools

        others = [[r for r in rows if r[0] == s and near(r[1], new[1])] for s in range(3) if s != new[0]]
        found = [c for c in itertools.product(*others) if all(near(a[1], b[1]) for a, b in itertools.combinations(c, 2))] if new[0] >= 0 else []
        return len(found), sum(m[2] for c in found for m in [*c, new] if m[0] == 0)

    for _ in range(200):
        new = (rnd.choice([-1, 0, 1, 2]), [float(rnd.randint(-2, 2)), float(rnd.randint(-2, 2))], rnd.random())
        old = held.pop(0) if len(held) == 12 else None
        want = brute(new, held), brute(old, held) if old else (0, 0.0)
        got = w.push(new[0], np.array(new[1]), new[2])
        assert [g[0] for g in got] == [x[0] for x in want] and [g[1] for g in got] == pytest.approx([x[1] for x in want])
        held.append(new)


def test_shared_join_gives_each_querys_totals(spark):
    rows = [r for r in _rows(150, 5) if r[1] in "ab"]
    made = spark.createDataFrame(rows, ROWS)
    tables = {s: made.where(F.col("streamId") == s).drop("streamId") for s in "ab"}
    for kind, radii in (("euclidean", (0.5, 2.0, 1.0)), ("cosine", (0.05, 0.3))):
        config = _config(radii, kind)
        shared = {r.queryId: (r["count"], round(r["sum"], 6), round(r["avg"], 6)) for r in run_shared(config, tables).collect()}
        single = {k: tuple(round(x, 6) for x in v.aggregates[0].select("count", "sum", "avg").first()) for k, v in run(config, tables).items()}
        assert shared == single and len(shared) == len(radii)
    assert {r.queryId: r["count"] for r in run_shared(_config((0.5, 2.0)), {s: t.limit(0) for s, t in tables.items()}).collect()} == {"q0": 0, "q1": 0}


def test_cosine_and_sketches_in_approximate_mode(spark):
    rows = [r for r in _rows(150, 6) if r[1] in "ab"]
    made = spark.createDataFrame(rows, ROWS)
    tables = {s: made.where(F.col("streamId") == s).drop("streamId") for s in "ab"}
    raw = _config((0.1,), "cosine")
    raw = type(raw)(raw.streams, raw.queries, True, raw.clustering)
    cosine = run(raw, tables)["q0"].aggregates[0].first()
    assert cosine.joinCount > 0
    plain = _config((2.0,))
    plain = type(plain)(plain.streams, plain.queries, True, plain.clustering)
    exact, guess = (run(plain, tables, by_sketch=b)["q0"].aggregates[0].first() for b in (False, True))
    assert guess.joinCount == pytest.approx(exact.joinCount, rel=0.05)


def test_area_by_lines_is_area_by_points(spark):
    rnd = random.Random(8)
    rows = [(rnd.uniform(-3, 3), rnd.uniform(-3, 3), float(rnd.randint(-3, 3)), float(rnd.randint(-3, 3))) for _ in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, a double, b double")
    got = df.select(geometry.area_fraction([F.col("x"), F.col("y")], [F.col("a"), F.col("b")], 1.0, 1.7), "x", "y", "a", "b").collect()
    for share, x, y, a, b in got:
        inside = sum((a + (i + 0.5) / 12 - x) ** 2 + (b + (j + 0.5) / 12 - y) ** 2 <= 1.7**2 for i in range(12) for j in range(12))
        assert share == pytest.approx(inside / 144)


def test_windows_are_clustered_by_themselves(spark):
    rnd = random.Random(9)
    rows = [(w, cx + rnd.random(), cy + rnd.random()) for w, far in ((1, 0), (2, 500)) for cx, cy in ((far, 0), (far + 100, 0)) for _ in range(20)] + [(3, 1.0, 1.0), (3, None, 2.0)]
    out = cluster.windowed(spark.createDataFrame(rows, "w int, x double, y double"), ["x", "y"], "w", 2, 8).collect()
    assert len(out) == 81
    for w in (1, 2):
        groups = {r.clusterId for r in out if r.w == w}
        assert len(groups) == 2
        for g in groups:
            mine = [r for r in out if (r.w, r.clusterId) == (w, g)]
            assert mine[0].centroid_x == pytest.approx(sum(r.x for r in mine) / len(mine))
            assert max(r.x for r in mine) - min(r.x for r in mine) < 2
    assert cluster.windowed(spark.createDataFrame([], "w int, x double, y double"), ["x", "y"], "w", 2, 1).count() == 0


def test_log_is_read_from_where_it_was_left(tmp_path):
    path = tmp_path / "log.tsv"
    path.write_text("".join(f"e{n}\t{json.dumps({'n': n, 'é': 'ü'})}\n" for n in range(7)) + "\n" + "e7\thalf")
    reader = log.EntryLogReader({"path": str(path), "batch": "3"})
    at, seen, steps = reader.initialOffset(), [], []
    for _ in range(5):
        rows, end = reader.read(at)
        rows = list(rows)
        assert list(reader.readBetweenOffsets(at, end)) == rows
        steps.append(len(rows))
        seen += [r[0] for r in rows]
        at = end
    assert seen == [f"e{n}" for n in range(7)] and steps == [3, 3, 1, 0, 0]
    with open(path, "a") as f:
        f.write("\n")
    assert [r[0] for r in reader.read(at)[0]] == ["e7"]


def test_a_batch_that_is_run_again_replaces_its_own(spark, tmp_path):
    e = stream_of(spark, str(tmp_path / "in"), [(1,), (2,)], "n int")
    sinks.stream_aggregates(e.groupBy("n").count(), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    import shutil

    shutil.rmtree(tmp_path / "check" / "commits")  # as if the driver was lost before the batch was committed
    sinks.stream_aggregates(e.groupBy("n").count(), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted((r.n, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (2, 1)]


def test_index_ends(spark):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(5)], "tupleId int, x double, y double")
    indexed = join.index_keys(df, ["x", "y"], [(0.0, 0.0)], 100.0)
    count = lambda *a: join.index_range(indexed, *a).count()
    assert (count(1.0, 3.0), count(1.0, 3.0, "low"), count(1.0, 3.0, "high"), count(1.0, 3.0, "none"), count(2.0, 2.0)) == (3, 2, 2, 1, 1)
    with pytest.raises(ValueError):
        count(1.0, 2.0, "some")
