"""Queries of a group share one set of copies, in every mode, and give what each gives alone."""

import random

import pytest
from pyspark.sql import functions as F

from proxjoin.functions import geometry
from proxjoin.operators import approx
from proxjoin.plans.config import parse
from proxjoin.plans.engine import run, run_shared

FIELDS = [{"name": "tupleId", "type": "string"}, {"name": "x", "type": "double"}, {"name": "y", "type": "double"}, {"name": "kind", "type": "string"}, {"name": "v", "type": "double"}]


def _tables(spark, n=240, seed=2):
    rnd = random.Random(seed)
    at = lambda: rnd.choice([rnd.uniform(-4, 4), rnd.gauss(0, 0.5), 1.0])
    rows = [(f"t{i}", at(), at(), rnd.choice("pq"), rnd.uniform(-1, 3), "abc"[i % 3]) for i in range(n)]
    rows += [("null", None, 1.0, "p", 1.0, "a"), ("nan", float("nan"), 1.0, "p", 1.0, "b"), ("far", float("inf"), 1.0, None, None, "c"), *rows[:3]]
    made = spark.createDataFrame(rows, "tupleId string, x double, y double, kind string, v double, s string")
    return {s: made.where(F.col("s") == s).drop("s") for s in "abc"}


def _config(asked, kind="euclidean", approximate=False):
    """asked: (id, streams, radius, kind of the first stream's rows or None)."""
    queries = []
    for name, between, radius, only in asked:
        stages = [{"type": "join", "between": list(between), "on": ["x", "y"], "radius": radius, "distanceType": kind}]
        if only:
            stages.append({"type": "where", "clauses": [{"stream": between[0], "field": "kind", "operator": "eq", "value": only}]})
        queries.append({"id": name, "stages": [*stages, {"type": "sum", "aggregateStream": between[-1], "aggregatableFields": ["v"]}]})
    return parse({"approximate": approximate, "streams": [{"id": s, "fields": FIELDS} for s in "abc"], "queries": queries})


ASKED = [("all", "abc", 1.0, None), ("two", "ca", 2.0, "p"), ("small", "ab", 0.7, "q"), ("same", "abc", 1.0, "p")]


def _rows(df, *names):
    return {r.queryId: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("kind", ["euclidean", "cosine"])
def test_estimates_of_a_group_are_those_of_each_alone(spark, kind):
    tables, asked = _tables(spark), ASKED if kind == "euclidean" else [(n, b, r / 10, o) for n, b, r, o in ASKED]
    config = _config(asked, kind, True)
    shared = _rows(run_shared(config, tables), "joinCount", "joinSum", "joinAvg")
    alone = {n: tuple(r.aggregates[0].select("joinCount", "joinSum", "joinAvg").first()) for n, r in run(config, tables).items()}
    assert list(alone) == [n for n, *_ in asked]
    assert {n: pytest.approx(v) for n, v in alone.items()} == shared and any(v[0] > 0 for v in shared.values())
    if kind == "euclidean":
        length = geometry.cell_length(0.7, 2)
        for name, between, radius, only in asked:
            streams = {s: tables[s].where("abs(x) < 1e9") for s in between}
            if only:
                streams[between[0]] = streams[between[0]].where(F.col("kind") == only)
            totals = approx.cell_totals(streams, ["x", "y"], radius, between[-1], "v", length=length)
            want = approx.per_cell(totals, len(between), len(between) - 1).agg(F.sum("joinCount"), F.sum("joinSum")).first()
            assert tuple(want) == pytest.approx(shared[name][:2])


def test_a_group_has_one_generate_and_a_query_alone_its_own_weights(spark):
    tables, config = _tables(spark), _config(ASKED, approximate=True)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    made = lambda text: sum("Generate inline" in line and "_o0#" in line for line in text.splitlines())
    assert made(plan(run_shared(config, tables))) == 1
    alone = plan(run(config, tables)["all"].aggregates[0])
    assert made(alone) == 1 and "_w_1" in alone and "_w_0" not in alone and "_w_2" not in alone


def test_a_group_that_is_empty_or_too_large(spark):
    empty = {s: t.limit(0) for s, t in _tables(spark, 9).items()}
    assert set(_rows(run_shared(_config(ASKED, approximate=True), empty), "joinCount", "joinSum", "joinAvg").values()) == {(0.0, 0.0, 0.0)}
    many = [approx.Asked(str(i), 1.0, ("a", "b"), "a", "v") for i in range(approx.MOST + 1)]
    with pytest.raises(ValueError, match="bitmap"):
        approx.group_totals(empty, ["x"], many)


def test_more_queries_than_a_bitmap_holds(spark):
    tables = _tables(spark, 60)
    config = _config([(f"q{i}", "ab", 0.5 + i % 3, None) for i in range(approx.MOST + 3)])
    found = _rows(run_shared(config, tables), "count")
    want = {r: run(_config([("q", "ab", r, None)]), tables)["q"].combinations.count() for r in (0.5, 1.5, 2.5)}
    assert found == {f"q{i}": (want[0.5 + i % 3],) for i in range(approx.MOST + 3)}


@pytest.mark.parametrize("kind", ["euclidean", "cosine"])
def test_stored_combinations_are_each_querys_own(spark, kind):
    tables, asked = _tables(spark, 120), ASKED if kind == "euclidean" else [(n, b, r / 10, o) for n, b, r, o in ASKED]
    plain, stored = (run(_config(asked, kind), tables, stored=s) for s in (False, True))
    for name in plain:
        a, b = plain[name], stored[name]
        assert a.combinations.columns == b.combinations.columns and a.rows.columns == b.rows.columns
        for f in ("combinations", "rows", "unjoined"):
            assert sorted(map(repr, getattr(a, f).collect())) == sorted(map(repr, getattr(b, f).collect())), (name, f)
        assert a.aggregates[0].first()["count"] == b.aggregates[0].first()["count"] > 0
