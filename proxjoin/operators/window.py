"""Count windows over bounded input: sequence numbers, and joins whose members lie within a window of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxjoin.operators.join import clique_join


def sequence(df: DataFrame, order: str, ties: Sequence[str] = (), name: str = "seq", buckets: int = 256) -> DataFrame:
    """Gapless numbers from 1 along (order, *ties).

    Ranges of ``order`` are counted first and rows numbered inside their range, so no task sees all rows.
    """
    value = F.col(order).cast("double")
    bounds = df.select(value.alias("v")).approxQuantile("v", [i / buckets for i in range(1, buckets)], 0.001)
    part = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(bounds))]), lambda c: c < value)) if bounds else F.lit(0)
    rows = df.withColumn("_part", F.when(value.isNull(), F.lit(-1)).otherwise(part))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(order, *ties)
    return rows.join(base, "_part").withColumn(name, F.col("_base") + F.row_number().over(inside)).drop("_part", "_base")


def window_join(streams: dict[str, DataFrame], on: Sequence[str], radius: float, length: int, kind: str = "euclidean", id_col: str = "tupleId", seq: str = "seq") -> DataFrame:
    """Combinations whose members stand within ``length`` consecutive rows, all streams counted together.

    The window is one more axis of the grid, so rows far apart in time never meet.
    """
    return clique_join(streams, on, radius, kind, id_col, band=(seq, length))


def changes(wide: DataFrame, streams: Sequence[str], last: int, length: int, seq: str = "seq") -> DataFrame:
    """Combinations as the window's stream of additions and retractions: a row when the last member arrives, and one with
    ``isExpired`` when the first has left, both with the number ``at`` of the row that brings it about.
    """
    at = [F.col(f"`{s}__{seq}`") for s in streams]
    both = F.array(F.struct(F.greatest(*at).alias("at"), F.lit(False).alias("isExpired")), F.struct((F.least(*at) + length).alias("at"), F.lit(True).alias("isExpired")))
    return wide.select("*", F.inline(both)).where(F.col("at") <= last)


def alive(wide: DataFrame, streams: Sequence[str], last: int, length: int, seq: str = "seq") -> DataFrame:
    """Combinations still in the window after row ``last``: what is left when expired ones are taken back."""
    oldest = F.least(*[F.col(f"`{s}__{seq}`") for s in streams])
    return wide.where(oldest > F.lit(last - length))
