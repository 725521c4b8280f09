"""Queries declared in JSON: streams with fields, and queries of stages join, where, count, sum, avg."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

OPERATORS = ("eq", "gt", "gte", "lt", "lte")
AGGREGATES = ("count", "sum", "avg")
CLUSTERINGS = ("grid", "kmeans")


@dataclass(frozen=True)
class Clause:
    stream: str
    field: str
    operator: str
    value: str


@dataclass(frozen=True)
class Aggregate:
    kind: str
    stream: str | None = None
    fields: tuple[str, ...] = ()
    group_by: tuple[tuple[str, str], ...] = ()
    having: tuple[Clause, ...] = ()


@dataclass(frozen=True)
class Query:
    id: str
    between: tuple[str, ...]
    on: tuple[str, ...]
    radius: float
    distance: str = "euclidean"
    where: tuple[Clause, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()

    @property
    def group(self) -> tuple[tuple[str, ...], str]:
        return tuple(sorted(self.on)), self.distance


@dataclass(frozen=True)
class EngineConfig:
    streams: dict[str, T.StructType]
    queries: tuple[Query, ...]
    approximate: bool = False
    clustering: dict = field(default_factory=lambda: {"type": "grid"})


@dataclass(frozen=True)
class QueryGroup:
    """Queries with the same axes and distance share cells and copies."""

    on: tuple[str, ...]
    distance: str
    queries: tuple[Query, ...]

    @property
    def name(self) -> str:
        return f"[{', '.join(self.on)}]-{self.distance.capitalize()}Distance"

    @property
    def r_min(self) -> float:
        return min(q.radius for q in self.queries)

    @property
    def r_max(self) -> float:
        return max(q.radius for q in self.queries)

    @property
    def streams(self) -> list[str]:
        return sorted({s for q in self.queries for s in q.between})


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _clauses(raw: Sequence[dict]) -> tuple[Clause, ...]:
    return tuple(Clause(c["stream"], c["field"], c["operator"], _text(c["value"])) for c in raw)


def _query(raw: dict, streams: dict[str, T.StructType]) -> Query:
    stages = raw["stages"]
    if not stages or stages[0]["type"] != "join":
        raise ValueError(f"query {raw['id']}: the first stage must be a join")
    join, where, aggregates = stages[0], (), []
    for stage in stages[1:]:
        if stage["type"] == "where":
            where += _clauses(stage.get("clauses") or ())
        elif stage["type"] in AGGREGATES:
            groups = tuple((g.get("stream", stage.get("aggregateStream")), g["field"]) if isinstance(g, dict) else (stage.get("aggregateStream"), g) for g in stage.get("groupableFields") or ())
            aggregates.append(Aggregate(stage["type"], stage.get("aggregateStream"), tuple(stage.get("aggregatableFields") or ()), groups, _clauses(stage.get("having") or ())))
        else:
            raise ValueError(f"query {raw['id']}: unknown stage {stage['type']!r}")
    q = Query(raw["id"], tuple(join["between"]), tuple(join["on"]), float(join["radius"]), (join.get("distanceType") or "euclidean").lower(), where, tuple(aggregates))
    for s in q.between:
        if s not in streams:
            raise ValueError(f"query {q.id}: unknown stream {s!r}")
        for a in q.on:
            if a not in streams[s].names:
                raise ValueError(f"query {q.id}: stream {s} has no field {a!r}")
    for c in q.where:
        if c.operator not in OPERATORS:
            raise ValueError(f"query {q.id}: unknown operator {c.operator!r}")
        if c.stream in streams and c.field not in streams[c.stream].names:
            raise ValueError(f"query {q.id}: stream {c.stream} has no field {c.field!r}")
    for a in q.aggregates:
        if a.kind != "count" and (a.stream not in q.between or not a.fields):
            raise ValueError(f"query {q.id}: {a.kind} needs a stream of the join and fields")
    return q


def parse(raw: dict) -> EngineConfig:
    """Fields of type double are double, all others text. Unknown stages, operators, streams and fields are errors."""
    kind = lambda t: T.DoubleType() if t == "double" else T.StringType()
    streams = {s["id"]: T.StructType([T.StructField(f["name"], kind(f["type"])) for f in s["fields"]]) for s in raw["streams"]}
    queries = tuple(_query(q, streams) for q in raw["queries"])
    if len({q.id for q in queries}) != len(queries):
        raise ValueError("query ids must differ")
    clustering = raw.get("clustering") or {"type": "grid"}
    if clustering.get("type") not in CLUSTERINGS:
        raise ValueError(f"unknown clustering {clustering.get('type')!r}; known: {', '.join(CLUSTERINGS)}")
    return EngineConfig(streams, queries, bool(raw.get("approximate", False)), clustering)


def load(path: str) -> EngineConfig:
    with open(path) as f:
        return parse(json.load(f))


def groups(queries: Sequence[Query]) -> list[QueryGroup]:
    by: dict[tuple, list[Query]] = {}
    for q in queries:
        by.setdefault(q.group, []).append(q)
    return [QueryGroup(on, kind, tuple(qs)) for (on, kind), qs in by.items()]
