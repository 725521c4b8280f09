"""COUNT, SUM and AVG over combinations: totals, groups, and the trace of running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxjoin.operators.join import SEP
from proxjoin.sources.scratch import stored


def average(total: Column, count: Column) -> Column:
    """0 where nothing was counted."""
    return F.when(count == 0, F.lit(0.0)).otherwise(total / count)


def totals(wide: DataFrame, stream: str | None = None, fields: Sequence[str] = (), query_id: str | None = None) -> DataFrame:
    """One row: count, and for each field its sum and average (``sum``, ``avg`` for the first, then by field)."""
    aggs = [F.count("*").alias("count")]
    for k, f in enumerate(fields):
        aggs.append(F.coalesce(F.sum(F.col(f"`{stream}{SEP}{f}`").cast("double")), F.lit(0.0)).alias("sum" if k == 0 else f"sum_{f}"))
    out = wide.agg(*aggs)
    for k, f in enumerate(fields):
        out = out.withColumn("avg" if k == 0 else f"avg_{f}", average(F.col("sum" if k == 0 else f"sum_{f}"), F.col("count")))
    return out.select(F.lit(query_id).alias("queryId"), "*") if query_id else out


def grouped(wide: DataFrame, stream: str, group_by: Sequence[tuple[str, str]], field: str | Sequence[str], having: Column | None = None) -> DataFrame:
    """count, and sum and avg of each field (``sum``, ``avg`` of the first, then by field) for each group of (stream,
    field) columns; ``having`` filters the result.
    """
    keys = [F.col(f"`{s}{SEP}{f}`").alias(f) for s, f in group_by]
    fields = [field] if isinstance(field, str) else list(field)
    names = {f: "" if k == 0 else f"_{f}" for k, f in enumerate(fields)}
    out = wide.groupBy(*keys).agg(F.count("*").alias("count"), *[F.sum(F.col(f"`{stream}{SEP}{f}`").cast("double")).alias(f"sum{n}") for f, n in names.items()])
    out = out.withColumns({f"avg{n}": average(F.col(f"sum{n}"), F.col("count")) for n in names.values()})
    return out if having is None else out.where(having)


def running(wide: DataFrame, arrival: Column, stream: str, field: str, buckets: int = 256) -> DataFrame:
    """count, sum and avg after each combination, in order of (arrival, joinId).

    Two passes: sums of ranges of arrival are added up first, then rows inside their range, so no task sees all rows. The
    ranges' bounds are a pass of their own, so combinations are stored, and not made anew for each.
    """
    rows = stored(wide.select(arrival.cast("double").alias("arrival"), "joinId", F.col(f"`{stream}{SEP}{field}`").cast("double").alias("v")))
    bounds = rows.approxQuantile("arrival", [i / buckets for i in range(1, buckets)], 0.001)
    part = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(bounds))]), lambda c: c < F.col("arrival"))) if bounds else F.lit(0)
    rows = rows.withColumn("part", part)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    base = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s0"))
    upto = Window.partitionBy("part").orderBy("arrival", "joinId").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(base, "part").select("joinId", (F.col("n0") + F.count("*").over(upto)).alias("count"), (F.col("s0") + F.coalesce(F.sum("v").over(upto), F.lit(0.0))).alias("sum"))
    return out.withColumn("avg", average(F.col("sum"), F.col("count")))
