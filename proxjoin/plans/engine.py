"""From a configuration and tables to each query's results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxjoin.functions import distance as D
from proxjoin.functions.predicates import clause, where
from proxjoin.operators import aggregate, approx, voronoi
from proxjoin.operators.join import SEP, clique_join, long_form, unjoined, within_all
from proxjoin.plans.config import EngineConfig, Query, QueryGroup, groups
from proxjoin.sources import scratch


@dataclass
class Results:
    """combinations and rows (long form) are None in approximate mode."""

    query: Query
    combinations: DataFrame | None
    rows: DataFrame | None
    aggregates: list[DataFrame] = field(default_factory=list)
    unjoined: DataFrame | None = None


def split(events: DataFrame, streams: list[str], column: str = "streamId") -> dict[str, DataFrame]:
    """One table of all streams told apart by a column, as one DataFrame for each."""
    return {s: events.where(F.col(column) == s) for s in streams}


def _aggregate(q: Query, wide: DataFrame, spec) -> DataFrame:
    if not spec.group_by:
        return aggregate.totals(wide, spec.stream, spec.fields, q.id)
    out = aggregate.grouped(wide, spec.stream or q.between[0], spec.group_by, spec.fields or q.on[:1])
    if spec.having:
        out = out.where(reduce(and_, [clause(out, c.field, c.operator, c.value) for c in spec.having]))
    return out.withColumn("queryId", F.lit(q.id))


def _marked(tables: dict[str, DataFrame], qs: Sequence[Query], compat_eq: str) -> dict[str, DataFrame]:
    """The rows that some query takes, with a bitmap of the queries whose clauses they pass; clauses reach the scan."""
    out = {}
    for s in sorted({s for q in qs for s in q.between}):
        passes = {i: reduce(and_, [F.coalesce(clause(tables[s], c.field, c.operator, c.value, compat_eq), F.lit(False)) for c in q.where if c.stream == s], F.lit(True)) for i, q in enumerate(qs) if s in q.between}
        bits = reduce(add, [F.when(p, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, p in passes.items()])
        out[s] = tables[s].withColumn(approx.BITS, bits).where(reduce(or_, passes.values()))
    return out


def _units(streams: dict[str, DataFrame], on: Sequence[str]) -> tuple[dict[str, DataFrame], list[str]]:
    """Axes as those of unit vectors; zero vectors have none."""
    units = D.normalise([F.col(f"`{a}`").cast("double") for a in sorted(on)])
    names = [f"_unit_{i}" for i in range(len(units))]
    some = reduce(or_, [F.col(u) != 0 for u in names])
    return {s: df.withColumns(dict(zip(names, units, strict=True))).where(some) for s, df in streams.items()}, names


def _asked(q: Query) -> approx.Asked:
    if any(a.group_by for a in q.aggregates):
        raise ValueError(f"query {q.id}: approximate mode has no groups; groups.grouped_by_sketch estimates them over combinations")
    stream = next((a.stream for a in q.aggregates if a.stream), q.between[0])
    value = next((a.fields[0] for a in q.aggregates if a.fields), q.on[0])
    return approx.Asked(q.id, D.cosine_as_euclidean(q.radius) if q.distance == "cosine" else q.radius, q.between, stream, value)


def _bitmaps(group: QueryGroup) -> list[tuple[Query, ...]]:
    """A group's queries in runs that fit a bitmap, the least radii first."""
    qs = sorted(group.queries, key=lambda q: q.radius)
    return [tuple(qs[i : i + approx.MOST]) for i in range(0, len(qs), approx.MOST)]


def _estimated(group: QueryGroup, tables: dict[str, DataFrame], compat_eq: str) -> list[tuple[dict[str, DataFrame], list[str], list[approx.Asked]]]:
    """Streams, axes and queries of each bitmap's run; cosine is estimated between unit vectors."""
    if group.distance not in ("euclidean", "cosine"):
        raise ValueError(f"approximate mode has no cells for {group.distance}")
    out = []
    for qs in _bitmaps(group):
        streams, on = _marked(tables, qs, compat_eq), list(group.on)
        if group.distance == "cosine":
            streams, on = _units(streams, on)
        out.append((streams, on, [_asked(q) for q in qs]))
    return out


def _together(qs: Sequence[Query], group: QueryGroup, tables: dict[str, DataFrame], id_col: str, compat_eq: str, per_part: int | None) -> DataFrame:
    """Combinations of queries with the same streams, joined once within their largest radius, with the bitmap of the
    queries that each belongs to, by its distances and its members' clauses.
    """
    names, euclidean = qs[0].between, group.distance == "euclidean"
    low, top = min(q.radius for q in qs), max(q.radius for q in qs)
    marked = _marked(tables, qs, compat_eq)
    wide = clique_join({s: marked[s] for s in names}, group.on, top, group.distance, id_col, low if euclidean else None, top if euclidean else None, rows_per_part=per_part)
    own = [f"{s}{SEP}{approx.BITS}" for s in names]
    passed = reduce(lambda a, b: a.bitwiseAND(b), [F.col(f"`{c}`") for c in own])
    near = lambda q: F.lit(True) if q.radius == top else within_all(names, group.on, q.radius, group.distance)
    bits = reduce(add, [F.when(approx.bit(i, passed) & near(q), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, q in enumerate(qs)])
    return wide.withColumn(approx.BITS, bits).drop(*own).where(F.col(approx.BITS) != 0)


def _by_streams(group: QueryGroup) -> list[tuple[Query, ...]]:
    out: dict[tuple, list[Query]] = {}
    for k, qs in enumerate(_bitmaps(group)):
        for q in qs:
            out.setdefault((k, q.between), []).append(q)
    return [tuple(qs) for qs in out.values()]


def run_shared(config: EngineConfig, tables: dict[str, DataFrame], id_col: str = "tupleId", compat_eq: str = "typed") -> DataFrame:
    """(queryId, count, sum, avg) of all queries, in one plan for each group and set of streams.

    A group's rows are copied and joined once, within its largest radius; each combination tells by its distances and its
    members' clauses which queries it belongs to. sum and avg are those of a query's first aggregated field, else 0. In
    approximate mode the columns are queryId, joinCount, joinSum, joinAvg, and all of a group's streams are copied once.
    """
    parts = []
    for group in groups(config.queries):
        if config.approximate:
            parts += [approx.estimate_group(streams, on, asked) for streams, on, asked in _estimated(group, tables, compat_eq)]
            continue
        for qs in _by_streams(group):
            wide, entries = _together(qs, group, tables, id_col, compat_eq, config.clustering.get("rowsPerPart")), []
            for i, q in enumerate(qs):
                spec = next((a for a in q.aggregates if a.stream and a.fields), None)
                value = F.col(f"`{spec.stream}{SEP}{spec.fields[0]}`").cast("double") if spec else F.lit(0.0)
                entries.append(F.when(approx.bit(i), F.struct(F.lit(q.id).alias("queryId"), value.alias("v"))))
            found = wide.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
            sums = found.groupBy("queryId").agg(F.count("*").alias("count"), F.sum("v").alias("sum"))
            every = wide.sparkSession.range(1).select(F.explode(F.array(*[F.lit(q.id) for q in qs])).alias("queryId"))
            both = every.join(sums, "queryId", "left").select("queryId", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("sum", F.lit(0.0)).alias("sum"))
            parts.append(both.withColumn("avg", aggregate.average(F.col("sum"), F.col("count"))))
    return reduce(DataFrame.unionByName, parts)


def run(config: EngineConfig, tables: dict[str, DataFrame], id_col: str = "tupleId", compat_eq: str = "typed", by_sketch: bool = False, stored: bool = False) -> dict[str, Results]:
    """Plans only: nothing is computed until a result is used. Queries of a group share the cells of its least radius, or,
    where the configuration asks for k-means, the centroids fitted here to the group's streams.

    In approximate mode a group's estimates come from one set of copies. With ``stored``, combinations of queries of a group
    with the same streams are joined once, written to the shared folder, and all results are read from there. Clustering's
    ``rowsPerPart`` deals crowded cells of a grid into parts.
    """
    out: dict[str, Results] = {}
    for group in groups(config.queries):
        kmeans = config.clustering.get("type") == "kmeans"
        if config.approximate:
            if kmeans:
                raise ValueError("approximate mode has cells of a grid only")
            for streams, on, asked in _estimated(group, tables, compat_eq):
                totals = None if by_sketch else approx.group_totals(streams, on, asked)
                for i, a in enumerate(asked):
                    own = {s: streams[s].where(approx.bit(i)) for s in a.names}
                    guess = approx.estimate(own, on, a.radius, a.stream, a.field, query_id=a.id, by_sketch=True) if by_sketch else approx.of_group(totals, i, a)
                    out[a.id] = Results(next(q for q in group.queries if q.id == a.id), None, None, [guess])
            continue
        centroids, joined = None, {}
        if kmeans:
            if stored:
                raise ValueError("combinations by k-means aren't stored for a group")
            known = config.clustering
            centroids = voronoi.fitted({s: tables[s] for s in group.streams}, group.on, int(known.get("k", 16)), int(known.get("iterations", 20)), group.distance)
        elif stored:
            for qs in _by_streams(group):
                once = scratch.stored(_together(qs, group, tables, id_col, compat_eq, config.clustering.get("rowsPerPart")))
                joined |= {q.id: once.where(approx.bit(i)).drop(approx.BITS) for i, q in enumerate(qs)}
        for q in group.queries:
            streams = {s: where(tables[s], s, q.where, compat_eq) for s in q.between}
            if q.id in joined:
                wide = joined[q.id]
            elif centroids is None:
                wide = clique_join(streams, q.on, q.radius, q.distance, id_col, group.r_min, group.r_max if q.distance == "euclidean" else None, rows_per_part=config.clustering.get("rowsPerPart"))
            else:
                wide = voronoi.voronoi_join(streams, q.on, q.radius, centroids, q.distance, id_col)
            shared = [c for c in tables[q.between[0]].columns if all(c in tables[s].columns for s in q.between) and c != "streamId"]
            out[q.id] = Results(q, wide, long_form(wide, q.between, shared, q.id), [_aggregate(q, wide, a) for a in q.aggregates], unjoined(streams, wide, id_col))
    return {q.id: out[q.id] for q in config.queries}
