"""A count window over whole streams without any task that sees all rows: row numbers become event time.

Stage one numbers rows by arrival. Each micro-batch is counted by ranges, as in batch, and written to a log of numbered
rows, a folder for each batch; the number that a batch begins with is the count of all before it, so a batch that is run
again gets the numbers it had. Stage two reads the log as a stream in which row n has the time of n seconds. A window of W
rows is then a range of W seconds: an ordinary stream-stream join on grid cells, whose state Spark drops as the watermark
passes. Each combination stands for two changes, its addition (when the last member arrives) and its retraction (when the
row arrives that pushes out the first), and each of the two is joined to the row of its number, so a retraction waits in
keyed state until that row comes. Every stage is spread by batch ranges, cells or row numbers.

``follow_log`` is the second stage without keyed state, for logs of many rows: the log itself holds what a window needs.
With each micro-batch the rows of the windows that change in it are read from the log, row numbers are one more axis of the
grid, so rows further apart than a window never meet, and the changes of just those numbers are the batch's result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from proxjoin.operators import approx
from proxjoin.operators.aggregate import average
from proxjoin.operators.join import SEP, long_form
from proxjoin.operators.window import sequence, window_join
from proxjoin.streaming.joins import event_time_join

SEQ, TIME = "seq", "seq_time"
#: Cells of a tile along each axis.
TILE = 16


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def number_rows(events: DataFrame, order: str, path: str, checkpoint: str, ties: Sequence[str] = (), **trigger) -> StreamingQuery:
    """Start writing the stream's rows with their numbers ``seq`` (from 1) to the log at ``path``.

    Within a micro-batch rows are numbered along (order, *ties), and batches follow one another: a row that comes in a
    later batch has a greater number, whatever its ``order``. A batch is complete once its count is written, and is then
    never written again.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if _exists(spark, f"{path}/counts/batch={number}/_SUCCESS"):
            return
        base = 0
        if _exists(spark, f"{path}/counts"):
            counts = spark.read.schema("n long, batch long").parquet(f"{path}/counts")
            base = counts.where(F.col("batch") < number).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # a row for each batch
        rows = sequence(batch, order, ties, SEQ).withColumn(SEQ, (F.col(SEQ) + F.lit(base)).cast("long"))
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        spark.range(1).select(F.lit(batch.count()).cast("long").alias("n")).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def numbered_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """The log as a stream, with its numbers as seconds in ``seq_time``; ``schema`` is that of the rows before numbering."""
    reader = spark.readStream.schema(T.StructType([*schema.fields, T.StructField(SEQ, T.LongType())]))
    rows = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{path}/rows/batch=*")
    return rows.withColumn(TIME, F.timestamp_seconds(SEQ))


def _due(waiting: DataFrame, rows: DataFrame, first: str, length: int, late: int) -> DataFrame:
    """``waiting`` rows as the row numbered ``at`` arrives; it comes within ``length`` rows after the row timed ``first``."""
    clock = rows.select(F.col(SEQ).alias("_n"), F.col(TIME).alias("_t")).withWatermark("_t", f"{late} seconds")
    soon = F.expr(f"`_t` BETWEEN `{first}` AND `{first}` + INTERVAL {length} SECONDS")
    return waiting.join(clock, (F.col("at") == F.col("_n")) & soon).drop("_n", "_t")


def window_changes(
    rows: DataFrame, streams: dict[str, DataFrame], on: Sequence[str], radius: float, length: int, kind: str = "euclidean", id_col: str = "tupleId", late: int = 0,
) -> DataFrame:
    """Combinations of the last ``length`` rows as a stream of additions and retractions: wide rows with joinId, the number
    ``at`` of the row that brings the change about, and ``isExpired``.

    ``rows`` are all rows of the numbered log, ``streams`` those of each stream that pass its clauses. ``late`` is by how
    many rows the log may be read out of order; 0 is right if a batch's files are read together.
    """
    names = list(streams)
    wide = event_time_join(streams, on, radius, f"{length - 1} seconds", f"{late} seconds", kind, id_col, TIME)
    at = [F.col(f"`{s}{SEP}{SEQ}`") for s in names]
    oldest, newest = F.least(*at), F.greatest(*at)
    both = F.array(F.struct(newest.alias("at"), F.lit(False).alias("isExpired")), F.struct((oldest + length).alias("at"), F.lit(True).alias("isExpired")))
    changes = wide.where(newest - oldest < length).select("*", F.inline(both))
    return _due(changes, rows, f"{names[0]}{SEP}{TIME}", length, late).drop(*[f"{s}{SEP}{TIME}" for s in names])


Changes = Callable[[DataFrame], DataFrame]


def follow_log(rows: DataFrame, log: str, changes: Changes, length: int, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start writing the ``changes`` of the log's windows to ``path``/batch=n as the stream ``rows`` of the log at ``log`` goes on.

    ``changes`` makes rows with ``at`` from a table of numbered rows. A batch gives it the rows of all windows since the last
    batch's end, and keeps what its own numbers bring about. How far a batch came is written once its result is, so a batch
    that is run again replaces its own result.
    """
    spark, kept = rows.sparkSession, rows.drop(TIME).schema
    if not _exists(spark, path):
        changes(spark.createDataFrame([], kept)).write.parquet(f"{path}/batch=-1")  # a stream without rows has a result

    def put(batch: DataFrame, number: int) -> None:
        last, before = batch.agg(F.max(SEQ)).first()[0], 0
        if last is None:
            return
        spark = batch.sparkSession
        if _exists(spark, f"{checkpoint}/upto"):
            upto = spark.read.schema("last long, batch long").parquet(f"{checkpoint}/upto")
            before = upto.where(F.col("batch") < number).agg(F.coalesce(F.max("last"), F.lit(0))).first()[0]  # a row for each batch
        known = spark.read.schema(kept).parquet(f"{log}/rows").select(*kept.names)
        found = changes(known.where((F.col(SEQ) > before - length) & (F.col(SEQ) <= last)))
        found.where((F.col("at") > before) & (F.col("at") <= last)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        spark.range(1).select(F.lit(max(before, last)).cast("long").alias("last")).write.mode("overwrite").parquet(f"{checkpoint}/upto/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{checkpoint}/query").trigger(**(trigger or {"availableNow": True})).start()


def window_change_batches(split: Callable[[DataFrame], dict[str, DataFrame]], on: Sequence[str], radius: float, length: int, kind: str = "euclidean", id_col: str = "tupleId") -> Changes:
    """For ``follow_log``: the rows of ``window_changes``; ``split`` gives the rows of each stream that pass its clauses."""

    def changes(known: DataFrame) -> DataFrame:
        streams = split(known)
        at = [F.col(f"`{s}{SEP}{SEQ}`") for s in streams]
        both = F.array(F.struct(F.greatest(*at).alias("at"), F.lit(False).alias("isExpired")), F.struct((F.least(*at) + length).alias("at"), F.lit(True).alias("isExpired")))
        return window_join(streams, on, radius, length, kind, id_col, SEQ).select("*", F.inline(both))

    return changes


def approx_change_batches(split: Callable[[DataFrame], dict[str, DataFrame]], on: Sequence[str], radius: float, stream: str, field: str, length: int, formula: str = "area") -> Changes:
    """For ``follow_log``: the rows of ``approx_changes``.

    Numbers lie in blocks of ``length``: a row comes in its own block and leaves in the next, at the same place there. So a
    cell's window at some number holds what has come in its block and what has yet to leave in it: two sums of what is
    there, and nothing is taken back, which would leave what rounding lost. A block of a cell is a group, whatever passes
    through the cell.
    """
    on = sorted(on)
    cells = [f"cell_{i}" for i in range(len(on))]

    def changes(known: DataFrame) -> DataFrame:
        streams = split(known)
        n, a = len(streams), list(streams).index(stream)
        copies = approx.weighted(streams, on, radius, stream, field, formula, carried=(SEQ,)).where("w > 0")
        both = F.array(F.struct(F.col(SEQ).alias("at"), F.lit(True).alias("_comes")), F.struct((F.col(SEQ) + length).alias("at"), F.lit(False).alias("_comes")))
        entries = copies.select(*cells, "k", "isReplica", "w", "v", F.inline(both)).withColumn("_block", F.floor(F.col("at") / F.lit(length)))
        w, v, of = F.col("w"), F.col("w") * F.col("v"), lambda k: F.col("k") == k
        held = {f"N_{k}": (w, of(k)) for k in range(n)} | {f"R_{k}": (w, of(k) & F.col("isReplica")) for k in range(n)}
        held |= {"V": (v, of(a)), "U": (v, of(a) & F.col("isReplica"))}
        only = lambda c, cond, comes: F.coalesce(F.sum(F.when(cond & (F.col("_comes") == comes), c)), F.lit(0.0))
        sums = [only(*what, comes).alias(f"{name}_{way}") for name, what in held.items() for way, comes in (("in", True), ("out", False))]
        # Only where all streams meet is there an estimate; a group has two entries at most for each number of a block.
        met = entries.repartition(*cells, "_block").groupBy(*cells, "_block").agg(F.collect_list(F.struct("at", "_comes", "k", "isReplica", "w", "v")).alias("_entries"), F.collect_set("k").alias("_met"))
        each = met.where(F.size("_met") == n).select(*cells, "_block", F.inline("_entries")).groupBy(*cells, "_block", "at").agg(*sums)
        block = Window.partitionBy(*cells, "_block")
        come, leave = block.orderBy("at").rowsBetween(Window.unboundedPreceding, 0), block.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
        come = {name: F.sum(f"{name}_in").over(come) for name in held}
        leave = {name: F.coalesce(F.sum(f"{name}_out").over(leave), F.lit(0.0)) for name in held}
        here = each.select(*cells, "_block", "at", *[(come[name] + leave[name]).alias(name) for name in held], *[(leave[name] + F.col(f"{name}_out")).alias(f"{name}_before") for name in held])

        def estimates(way: str) -> tuple[Column, Column]:
            prod = lambda name, skip=-1: reduce(mul, [F.col(f"{name}_{k}{way}") for k in range(n) if k != skip], F.lit(1.0))
            return prod("N") - prod("R"), F.col(f"V{way}") * prod("N", a) - F.col(f"U{way}") * prod("R", a)

        now, before = estimates(""), estimates("_before")
        found = here.select(*cells, "_block", "at", now[0].alias("cellCount"), now[1].alias("cellSum"), before[0].alias("_count"), before[1].alias("_sum"))
        # The first change of a block begins with what is to leave in it.
        change = lambda c, first: F.col(c) - F.coalesce(F.lag(c).over(block.orderBy("at")), F.col(first))
        out = found.select(*cells, "at", change("cellCount", "_count").alias("joinCount"), change("cellSum", "_sum").alias("joinSum"), "cellCount", "cellSum")
        return out.where("joinCount <> 0 OR joinSum <> 0")

    return changes


def change_rows(changes: DataFrame, streams: Sequence[str], fields: Sequence[str], query_id: str | None = None) -> DataFrame:
    """Changes in long form: a row for each member of a combination, with joinId, at and isExpired."""
    return long_form(changes, streams, fields, query_id, ("at", "isExpired"))


def change_totals(changes: DataFrame, stream: str, fields: Sequence[str] = ()) -> DataFrame:
    """One row: count of what is left in the window, and for each field its sum and average (named as in ``totals``)."""
    sign = F.when(F.col("isExpired"), F.lit(-1)).otherwise(F.lit(1))
    aggs = [F.coalesce(F.sum(sign), F.lit(0)).alias("count")]
    aggs += [F.coalesce(F.sum(F.col(f"`{stream}{SEP}{f}`").cast("double") * sign), F.lit(0.0)).alias("sum" if k == 0 else f"sum_{f}") for k, f in enumerate(fields)]
    out = changes.agg(*aggs)
    average = lambda c: F.when(F.col("count") == 0, F.lit(0.0)).otherwise(F.col(c) / F.col("count"))
    return out.withColumns({"avg" if k == 0 else f"avg_{f}": average("sum" if k == 0 else f"sum_{f}") for k, f in enumerate(fields)})


def _products(totals: np.ndarray, n: int, a: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated counts and sums from rows of N and R of each stream, V and U."""
    whole, copied, v, u = totals[:, :n], totals[:, n : 2 * n], totals[:, 2 * n], totals[:, 2 * n + 1]
    rest = [k for k in range(n) if k != a]
    return whole.prod(axis=1) - copied.prod(axis=1), v * whole[:, rest].prod(axis=1) - u * copied[:, rest].prod(axis=1)


def approx_changes(
    rows: DataFrame, streams: dict[str, DataFrame], on: Sequence[str], radius: float, stream: str, field: str, length: int, formula: str = "area", late: int = 0,
) -> DataFrame:
    """Approximate mode over the window as a stream: (cells, at, joinCount, joinSum, cellCount, cellSum), what the row numbered
    ``at`` changes in a cell's estimates, by copies that come or leave, and the cell's estimates then.

    Every copy stands for two entries, one as it comes and one, taken back, as the row arrives that pushes it out. The
    state of a cell is its N, R, V and U, and how many copies N and R are of, 4 n + 2 numbers for n streams, whatever passes
    through it. A sum of no copies is 0, whatever rounding left of it, and a cell without copies goes. Cells are kept together in tiles of ``TILE`` along each axis, a group each, so that
    a group's worth of cells is one vector operation.
    """
    on, n, a = sorted(on), len(streams), list(streams).index(stream)
    cells = [f"cell_{i}" for i in range(len(on))]
    copies = approx.weighted(streams, on, radius, stream, field, formula, carried=(SEQ, TIME)).where("w > 0").withWatermark(TIME, f"{late} seconds")
    both = F.array(F.struct(F.col(SEQ).alias("at"), F.lit(1.0).alias("sign")), F.struct((F.col(SEQ) + length).alias("at"), F.lit(-1.0).alias("sign")))
    due = _due(copies.select(*cells, "k", "isReplica", "w", "v", TIME, F.inline(both)), rows, TIME, length, late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches))
        known = np.array(state.get[0], np.int64).reshape(-1, len(cells)) if state.exists else np.zeros((0, len(cells)), np.int64)
        places, cell = np.unique(np.vstack([known, new[cells].to_numpy(np.int64)]), axis=0, return_inverse=True)
        cell = cell.ravel()
        held = np.zeros((len(places), 4 * n + 2))
        held[cell[: len(known)]] = np.array(state.get[1]).reshape(len(known), -1) if state.exists else 0
        cell = cell[len(known) :]
        order = np.lexsort((new["at"].to_numpy(), cell))
        new, cell = new.iloc[order], cell[order]
        w, k, copied = (new["w"] * new["sign"]).to_numpy(), new["k"].to_numpy(), new["isReplica"].to_numpy(dtype=bool)
        entries = np.zeros((len(new), 4 * n + 2))
        each = np.arange(len(new))
        entries[each, k] = w
        entries[each[copied], n + k[copied]] = w[copied]
        entries[:, 2 * n] = np.where(k == a, w * new["v"].to_numpy(), 0.0)
        entries[:, 2 * n + 1] = np.where(copied, entries[:, 2 * n], 0.0)
        entries[each, 2 * n + 2 + k] = new["sign"].to_numpy()
        entries[each[copied], 3 * n + 2 + k[copied]] = new["sign"].to_numpy()[copied]
        first = np.flatnonzero(np.r_[True, np.diff(cell) != 0])
        run = np.cumsum(np.r_[True, np.diff(cell) != 0]) - 1
        upto = np.cumsum(entries, axis=0)
        totals = upto - np.vstack([np.zeros((1, 4 * n + 2)), upto])[first][run] + held[cell]
        copies_of = totals[:, 2 * n + 2 :]
        totals[:, : 2 * n + 2][np.column_stack([copies_of, copies_of[:, a], copies_of[:, n + a]]) == 0] = 0.0
        at = new["at"].to_numpy()
        last = np.flatnonzero(np.r_[(np.diff(at) != 0) | (np.diff(cell) != 0), True])
        counts, sums = _products(totals[last], n, a)
        fresh = np.r_[True, np.diff(cell[last]) != 0]
        was_count, was_sum = _products(held[cell[last]], n, a)
        was_count, was_sum = np.where(fresh, was_count, np.r_[0.0, counts[:-1]]), np.where(fresh, was_sum, np.r_[0.0, sums[:-1]])
        held[cell[last]] = totals[last]  # the last of a cell's rows wins
        kept = (held[:, 2 * n + 2 :] > 0).any(axis=1)
        state.update((places[kept].ravel().tolist(), held[kept].ravel().tolist()))
        out = pd.DataFrame({**{c: places[cell[last], i] for i, c in enumerate(cells)}, "at": at[last], "joinCount": counts - was_count, "joinSum": sums - was_sum, "cellCount": counts, "cellSum": sums})
        yield out[(out["joinCount"] != 0) | (out["joinSum"] != 0)]

    kinds = ", ".join(f"{c} long" for c in cells)
    tiles = due.drop(TIME).withColumns({f"_tile_{i}": F.floor(F.col(c) / TILE) for i, c in enumerate(cells)})
    return tiles.groupBy(*[f"_tile_{i}" for i in range(len(cells))]).applyInPandasWithState(
        step, f"{kinds}, at long, joinCount double, joinSum double, cellCount double, cellSum double", "cells array<long>, totals array<double>", "append", GroupStateTimeout.NoTimeout
    )


def approx_totals(changes: DataFrame) -> DataFrame:
    """joinCount, joinSum, joinAvg of the window after the last row: each cell's estimates after its last change, added up.

    Changes themselves aren't: what rounding loses in each would be left where nothing else is.
    """
    last = changes.groupBy(*[c for c in changes.columns if c.startswith("cell_")]).agg(F.max_by(F.struct("cellCount", "cellSum"), "at").alias("_last"))
    out = last.agg(F.coalesce(F.sum("_last.cellCount"), F.lit(0.0)).alias("joinCount"), F.coalesce(F.sum("_last.cellSum"), F.lit(0.0)).alias("joinSum"))
    return out.withColumn("joinAvg", average(F.col("joinSum"), F.col("joinCount")))
