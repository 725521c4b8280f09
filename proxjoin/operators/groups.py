"""GROUP BY and HAVING by sketches: no group is counted exactly, none above the threshold is lost.

One pass where rows lie gives each partition's summary: a Count-Min sketch of counts, one of each value, and up to
``capacity`` candidates for frequent groups. Sketches are merged by addition. Candidates are a summary that forgets evenly:
when more groups than that are held, all give up as much as the next one has, so a group that isn't held has at most
rows / (capacity + 1), and that holds for the sum over partitions, too. What is shuffled is bounded by partitions times
the size of a summary, whatever the number of groups. Groups are named ``stream.field=value``, several fields joined by
``&``.

Estimates never fall below the truth for values from 0. A threshold so low that a group above it might not be among the
candidates is an error when the plan runs, not a short result; for such thresholds there is a second pass over the rows
(``again``), which needs no candidates: an estimate is never below the truth, so every group above is found by its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import ceil, e, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxjoin.operators import sketch
from proxjoin.operators.aggregate import average
from proxjoin.operators.join import SEP
from proxjoin.sources.scratch import stored

CAPACITY = 4096


def size(error: float, confidence: float) -> tuple[int, int]:
    """Buckets and rows: an estimate is too large by more than ``error`` x total with a chance below 1 - ``confidence``."""
    if not 0 < error < 1 or not 0 < confidence < 1:
        raise ValueError("error and confidence lie between 0 and 1")
    return ceil(e / error), max(1, ceil(log(1 / (1 - confidence))))


def group_key(group_by: Sequence[tuple[str, str]]) -> Column:
    """``stream.field=value`` of a combination; a null value is ``null``."""
    parts = [F.concat(F.lit(f"{s}.{f}="), F.coalesce(F.col(f"`{s}{SEP}{f}`").cast("string"), F.lit("null"))) for s, f in group_by]
    return F.concat_ws("&", *parts)


def bucket_of(row: int, key: str, buckets: int) -> int:
    """As ``sketch.bucket``."""
    return int(hashlib.md5(f"{row}#{key}".encode(), usedforsecurity=False).hexdigest()[:8], 16) % buckets


def forget(held: pd.Series, capacity: int) -> pd.Series:
    """At most ``capacity`` groups, each less what the next one had."""
    if len(held) <= capacity:
        return held
    held = held - np.partition(held.to_numpy(), -capacity - 1)[-capacity - 1]
    return held[held > 0]


def summarise(rows: DataFrame, key: str, values: Sequence[str], buckets: int, depth: int, capacity: int) -> DataFrame:
    """(part, row, bucket, key, value): parts ``count`` and each value's are sketches, ``candidate`` is what groups are held
    with, ``rows`` how many rows there are. Negative values are errors, as no estimate would bound them.
    """
    values = list(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((1 + len(values), depth, buckets))
        held, n = pd.Series(dtype=float), 0
        for batch in batches:
            frame = batch.to_pandas()
            if len(frame) and (frame[values] < 0).any(axis=None):
                raise ValueError("sketches of sums need values from 0")
            each = frame.assign(_n=1.0).groupby(key)[["_n", *values]].sum()
            for row in range(depth):
                at = np.array([bucket_of(row, k, buckets) for k in each.index], dtype=np.int64)
                for j, c in enumerate(each.columns):
                    np.add.at(cells[j, row], at, each[c].to_numpy())
            held, n = forget(held.add(each["_n"], fill_value=0.0), capacity) if capacity else held, n + len(frame)
        for j, c in enumerate(["count", *values]):
            row, at = np.nonzero(cells[j])
            yield pa.RecordBatch.from_pydict({"part": [c] * len(row), "row": row.tolist(), "bucket": at.tolist(), "key": [None] * len(row), "value": cells[j][row, at].tolist()}, schema=SUMMARY)
        m = len(held)
        yield pa.RecordBatch.from_pydict({"part": ["candidate"] * m + ["rows"], "row": [None] * (m + 1), "bucket": [None] * (m + 1), "key": [*held.index, None], "value": [*held.tolist(), float(n)]}, schema=SUMMARY)

    parts = rows.select(F.col(key), *values).mapInArrow(run, "part string, row long, bucket long, key string, value double")
    return parts.groupBy("part", "row", "bucket", "key").agg(F.sum("value").alias("value"))


SUMMARY = pa.schema([("part", pa.string()), ("row", pa.int64()), ("bucket", pa.int64()), ("key", pa.string()), ("value", pa.float64())])


def grouped_by_sketch(
    wide: DataFrame, stream: str, group_by: Sequence[tuple[str, str]], fields: Sequence[str], more_than: float, error: float = 1e-4, confidence: float = 0.95, capacity: int = CAPACITY,
    again: bool = False,
) -> DataFrame:
    """(key, count, and sum and avg of each field) of the groups with a count above ``more_than``, all estimated.

    With ``again`` no candidates are held: rows are stored, and a second pass asks the sketch for each of their groups, so
    any threshold has all of its groups, whatever their number.
    """
    buckets, depth = size(error, confidence)
    names = {f: f"_v{k}" for k, f in enumerate(fields)}
    rows = wide.select(group_key(group_by).alias("key"), *[F.coalesce(F.col(f"`{stream}{SEP}{f}`").cast("double"), F.lit(0.0)).alias(v) for f, v in names.items()])
    if again:
        rows = stored(rows)  # combinations are made once
    summary = stored(summarise(rows, "key", list(names.values()), buckets, depth, 0 if again else capacity))
    total = summary.where("part = 'rows'").select(F.col("value").alias("_all"))
    asked = summary.where("part = 'candidate'").select("key").crossJoin(total)  # one row
    low = F.col("_all") / (capacity + 1) > more_than
    checked = F.when(low, F.raise_error(F.lit(f"a group of more than {more_than} rows may not be among {capacity} candidates"))).otherwise(F.col("key"))
    out = rows.select("key").distinct() if again else asked.select(F.coalesce(checked.cast("string"), F.col("key")).alias("key"))
    for name, part in {"count": "count", **{f: v for f, v in names.items()}}.items():
        cells = summary.where(F.col("part") == part).select("row", "bucket", "value")
        guess = sketch.query(cells, out.select("key"), "key", buckets, depth).withColumnRenamed("estimate", name if name == "count" else f"_sum_{name}")
        out = out.join(guess, "key")
        if part == "count":
            out = out.where(F.col("count") > more_than)
    for k, f in enumerate(fields):
        tail = "" if k == 0 else f"_{f}"
        out = out.withColumn(f"sum{tail}", F.col(f"_sum_{f}")).withColumn(f"avg{tail}", average(F.col(f"_sum_{f}"), F.col("count")))
    return out.drop(*[f"_sum_{f}" for f in fields])
