"""A configuration over the count window of a numbered stream, exact or approximate, with all of its aggregates.

Each query becomes one stream that writes changes: in exact mode the members of combinations that come or go, in
approximate mode what a cell's estimates change by. Totals, groups and HAVING are read from what is written, so they hold
after any restart, and can be asked for at any row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from proxjoin.functions import distance as D
from proxjoin.functions.predicates import clause, where
from proxjoin.operators.aggregate import average
from proxjoin.operators.join import SEP
from proxjoin.plans.config import Aggregate, EngineConfig, Query
from proxjoin.plans.stream import WINDOW
from proxjoin.streaming import numbered


def _streams(q: Query, log: DataFrame, column: str) -> dict[str, DataFrame]:
    """The rows of each of the query's streams that pass its clauses; the others take their place in the window only."""
    return {s: where(log.where(F.col(column) == s).drop(column), s, q.where) for s in q.between}


def _unit(q: Query, streams: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], list[str], float]:
    """Axes and radius for cells: those of unit vectors for cosine."""
    if q.distance == "euclidean":
        return streams, list(q.on), q.radius
    if q.distance != "cosine":
        raise ValueError(f"approximate mode has no cells for {q.distance}")
    units = D.normalise([F.col(f"`{a}`").cast("double") for a in sorted(q.on)])
    names = [f"_unit_{i}" for i in range(len(units))]
    some = reduce(lambda a, b: a | b, [F.col(n) != 0 for n in names])
    return {s: df.withColumns(dict(zip(names, units, strict=True))).where(some) for s, df in streams.items()}, names, D.cosine_as_euclidean(q.radius)


def _aggregated(q: Query) -> tuple[str, str]:
    """Stream and field of approximate sums: those of the first aggregate that names them."""
    return next(((a.stream, a.fields[0]) for a in q.aggregates if a.stream and a.fields), (q.between[0], q.on[0]))


def start(config: EngineConfig, spark: SparkSession, log: str, schema: T.StructType, path: str, checkpoint: str, window: int = WINDOW, column: str = "streamId", id_col: str = "tupleId", late: int = 0, **trigger) -> dict[str, StreamingQuery]:
    """A started stream for each query, which appends changes to ``path``/<query>; ``log`` is where rows are numbered."""
    out = {}
    for q in config.queries:
        rows = numbered.numbered_stream(spark, log, schema)
        if config.approximate:
            _, on, radius = _unit(q, {})
            split = lambda known, q=q: _unit(q, _streams(q, known, column))[0]
            changes = numbered.approx_change_batches(split, on, radius, *_aggregated(q), window)
        else:
            split = lambda known, q=q: _streams(q, known, column)
            changes = numbered.window_change_batches(split, q.on, q.radius, window, q.distance, id_col)
        out[q.id] = numbered.follow_log(rows, log, changes, window, f"{path}/{q.id}", f"{checkpoint}/{q.id}", **trigger)
    return out


def _totals(q: Query, changes: DataFrame, spec: Aggregate) -> DataFrame:
    stream, fields = spec.stream or q.between[0], spec.fields or q.on[:1]
    if not spec.group_by:
        out = numbered.change_totals(changes, stream, spec.fields)
        return out.select(F.lit(q.id).alias("queryId"), "*")
    sign = F.when(F.col("isExpired"), F.lit(-1)).otherwise(F.lit(1))
    keys = [F.col(f"`{s or q.between[0]}{SEP}{f}`").alias(f) for s, f in spec.group_by]
    names = {f: "" if k == 0 else f"_{f}" for k, f in enumerate(fields)}
    sums = [F.sum(F.col(f"`{stream}{SEP}{f}`").cast("double") * sign).alias(f"sum{n}") for f, n in names.items()]
    out = changes.groupBy(*keys).agg(F.sum(sign).alias("count"), *sums).where("count > 0")
    out = out.withColumns({f"avg{n}": average(F.col(f"sum{n}"), F.col("count")) for n in names.values()})
    if spec.having:
        out = out.where(reduce(and_, [clause(out, c.field, c.operator, c.value) for c in spec.having]))
    return out.withColumn("queryId", F.lit(q.id))


def written(spark: SparkSession, path: str, q: Query, upto: int | None = None) -> DataFrame:
    """A query's changes so far, or up to row ``upto``."""
    rows = spark.read.parquet(f"{path}/{q.id}").drop("batch")
    return rows if upto is None else rows.where(F.col("at") <= upto)


def totals(config: EngineConfig, spark: SparkSession, path: str, upto: int | None = None) -> dict[str, list[DataFrame]]:
    """What each query's aggregates give for the window after the last row, or after row ``upto``."""
    out = {}
    for q in config.queries:
        changes = written(spark, path, q, upto)
        if config.approximate:
            out[q.id] = [numbered.approx_totals(changes).select(F.lit(q.id).alias("queryId"), "*")]
        else:
            out[q.id] = [_totals(q, changes, a) for a in q.aggregates]
    return out


def members(spark: SparkSession, path: str, q: Query, fields: list[str], upto: int | None = None) -> DataFrame:
    """A query's changes in long form: a row for each member, with joinId, at, isExpired and queryId."""
    return numbered.change_rows(written(spark, path, q, upto), q.between, fields, q.id)
