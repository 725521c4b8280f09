"""Cells that follow the density: parts of crowded cells are bounded, and no combination is lost or doubled."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proxjoin.functions import geometry
from proxjoin.operators import grid, join
from proxjoin.plans.config import parse
from proxjoin.plans.engine import run

ROW = "tupleId string, x double, y double, seq long"
AXES = ["x", "y"]


def _ids(df):
    return sorted(r.joinId for r in df.select("joinId").collect())


def _tables(spark, rows, names="abc"):
    made = spark.createDataFrame([(s, f"{s}{i}", *r, i) for i, (s, *r) in enumerate(rows)], f"s string, {ROW}")
    return {s: made.where(F.col("s") == s).drop("s") for s in names}


point = st.tuples(st.sampled_from("abc"), st.sampled_from([0.0, 0.1, 0.7, 1.0, 1.4, -0.7, 30.0]), st.sampled_from([0.0, 0.5, 1.0, -1.0]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(point, min_size=1, max_size=40), st.integers(1, 5))
def test_parts_lose_and_double_nothing(spark, rows, most):
    tables = _tables(spark, rows)
    assert _ids(join.clique_join(tables, ["x", "y"], 1.0, rows_per_part=most)) == _ids(join.nested_loop_join(tables, ["x", "y"], 1.0))


@pytest.mark.parametrize("kind,radius", [("euclidean", 1.0), ("cosine", 0.2)])
def test_uneven_streams_and_bands(spark, kind, radius):
    rnd = random.Random(5)
    rows = [(rnd.choice("aaaaab"), rnd.gauss(1, 0.6), rnd.gauss(1, 0.6)) for _ in range(150)] + [("a", None, 1.0), ("b", float("inf"), 1.0), ("b", 0.0, 0.0)]
    tables = _tables(spark, rows, "ab")
    finite = {s: t.where("abs(x) < 1e9") for s, t in tables.items()}
    for band in (None, ("seq", 20)):
        want = _ids(join.nested_loop_join(finite, ["x", "y"], radius, kind, band=band))
        assert want and _ids(join.clique_join(tables, ["x", "y"], radius, kind, band=band, rows_per_part=7)) == want


def test_largest_part_of_a_crowded_point_is_bounded(spark):
    rows = [("abc"[i % 3], 1.0, 1.0) for i in range(3000)] + [("ab"[i % 2], 9.0, 9.0) for i in range(600)]
    axes = [F.col(a) for a in AXES]
    tables, length, keys, most = _tables(spark, rows), geometry.cell_length(1.0, 2), ["cell_0", "cell_1"], 200
    crowded = grid.crowded_cells([grid.copy_counts(t, axes, length, 1.0) for t in tables.values()], keys, most)
    assert {tuple(r)[2:] for r in crowded.collect()} == {(5, 5, 5), (0, 0, 0)}
    seen = {}
    for k, t in enumerate(tables.values()):
        copies = grid.replicate(t, axes, length, 1.0)
        assert {tuple(r) for r in copies.groupBy(*keys).count().collect()} == {tuple(r) for r in grid.copy_counts(t, axes, length, 1.0).collect()}
        out = grid.dealt(copies, crowded, keys, k, F.xxhash64("tupleId")).groupBy(*keys, "_part").count().collect()
        assert max(r["count"] for r in out) < 1.5 * most and {r._part for r in out} == set(range(125))
        # No row of the cells that the third stream doesn't reach is left.
        assert all(r.cell_0 < 8 for r in out)
        for r in out:
            seen.setdefault((r.cell_0, r.cell_1, r._part), set()).add(k)
    assert set(map(len, seen.values())) == {3}


def test_a_configuration_names_the_size_of_parts(spark):
    rows = [("ab"[i % 2], 1.0 + i % 3, 1.0) for i in range(60)]
    tables = _tables(spark, rows, "ab")
    fields = [{"name": n, "type": "string" if n == "tupleId" else "double"} for n in ("tupleId", "x", "y")]
    raw = {"streams": [{"id": s, "fields": fields} for s in "ab"], "queries": [{"id": "q", "stages": [{"type": "join", "between": ["a", "b"], "on": ["x", "y"], "radius": 1.0}]}]}
    plain, parts = (run(parse(raw | {"clustering": {"type": "grid", **more}}), tables)["q"].combinations for more in ({}, {"rowsPerPart": 4}))
    assert _ids(plain) == _ids(parts) and "_part" in parts._jdf.queryExecution().optimizedPlan().toString()
    for wrong in ({"rows_per_part": 0}, {"rows_per_part": 4, "salt": 2}):
        with pytest.raises(ValueError, match="rows_per_part"):
            join.clique_join(tables, ["x", "y"], 1.0, **wrong)
