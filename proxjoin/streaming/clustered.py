"""A count window joined by clusters that are fitted anew to each window.

The source is a log of numbered rows. With each micro-batch, the rows of the windows that end in it (the batch and the rows
before it that its first row's window holds) are read from the log, clustered, and joined by territories; combinations whose
last member came in the batch are its result. A batch's result replaces its own folder, so a batch that is run again
leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proxjoin.operators.join import SEP
from proxjoin.operators.voronoi import kmeans_join
from proxjoin.streaming.numbered import SEQ


def kmeans_window_join(
    rows: DataFrame, log: str, names: Sequence[str], on: Sequence[str], radius: float, length: int, path: str, checkpoint: str, k: int = 16, iterations: int = 20,
    kind: str = "euclidean", id_col: str = "tupleId", column: str = "streamId", **trigger,
) -> StreamingQuery:
    """Start joining the stream ``rows`` of the log at ``log``: combinations within ``length`` rows, in ``path``/batch=n."""

    def put(batch: DataFrame, number: int) -> None:
        first, last = batch.agg(F.min(SEQ), F.max(SEQ)).first()
        if first is None:
            return
        known = batch.sparkSession.read.schema(rows.drop("seq_time").schema).parquet(f"{log}/rows")
        held = known.where((F.col(SEQ) > first - length) & (F.col(SEQ) <= last))
        streams = {s: held.where(F.col(column) == s).drop(column) for s in names}
        wide = kmeans_join(streams, on, radius, k, iterations, kind, id_col, (SEQ, length), distinct=True)
        fresh = F.greatest(*[F.col(f"`{s}{SEP}{SEQ}`") for s in names]) >= first
        wide.where(fresh).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
