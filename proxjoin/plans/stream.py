"""A configuration over a stream: source, filters, count window, running aggregates, sink."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proxjoin.functions.predicates import clause
from proxjoin.plans.config import EngineConfig, Query
from proxjoin.sources import sinks
from proxjoin.streaming.counted import count_window

WINDOW = 10_000


def running(q: Query, events: DataFrame, order: str, window: int = WINDOW, key: str | None = None, column: str = "streamId") -> DataFrame:
    """After each row of the query's streams: what it added and what expired, count, sum and avg so far, queryId.

    Rows that a clause refuses take their place in the window, and join nothing. The first aggregate that names a stream
    and a field is kept; without one, combinations are counted. A ``key`` gives each of its values a window.
    """
    own = events.where(F.col(column).isin(*q.between))
    passes = [(F.col(column) != c.stream) | F.coalesce(clause(events, c.field, c.operator, c.value), F.lit(False)) for c in q.where]
    stream, field = next(((a.stream, a.fields[0]) for a in q.aggregates if a.stream and a.fields), (q.between[0], q.on[0]))
    names = {a: f"_axis_{i}" for i, a in enumerate(sorted(q.on))}
    rows = own.select(
        (F.col(key).cast("string") if key else F.lit("all")).alias("_key"), F.col(order).alias("_order"),
        (F.when(reduce(and_, passes), F.col(column)).otherwise(F.lit("")) if passes else F.col(column)).alias("_stream"),
        *[F.col(a).cast("double").alias(n) for a, n in names.items()], F.coalesce(F.col(field).cast("double"), F.lit(0.0)).alias("_value"),
    )
    out = count_window(rows, "_key", "_order", "_stream", list(names.values()), "_value", q.between, q.radius, window, stream, q.distance)
    return out.withColumn("queryId", F.lit(q.id))


def run_stream(config: EngineConfig, events: DataFrame, path: str, checkpoint: str, order: str = "tupleId", window: int = WINDOW, key: str | None = None, **trigger) -> dict[str, StreamingQuery]:
    """A started stream for each query, which appends its running aggregates to ``path``/<query>, a row for each row.

    A stream that was stopped goes on from its checkpoint, with the window as it was. All rows of a window are one task's;
    ``windowed.start`` spreads them, and runs what this form has no place for.
    """
    for q in config.queries:
        if config.approximate or len(q.aggregates) > 1 or any(a.group_by or a.having or len(a.fields) > 1 for a in q.aggregates):
            raise ValueError(f"query {q.id}: approximate mode, groups, several fields and several aggregates need windowed.start")
    return {q.id: sinks.stream_rows(running(q, events, order, window, key), f"{path}/{q.id}", f"{checkpoint}/{q.id}", **trigger) for q in config.queries}
