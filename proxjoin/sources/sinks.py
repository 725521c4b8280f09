"""Where results go: files by query, the current value of an aggregate, or nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def write_rows(df: DataFrame, path: str, kind: str = "parquet", by: str | None = "queryId", mode: str = "append") -> None:
    """Join rows as parquet or csv, in a folder for each query."""
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by and by in df.columns else writer).format(kind).save(path)


def stream_rows(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet", by: str | None = None, **trigger) -> StreamingQuery:
    writer = df.writeStream.format(kind).outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.partitionBy(by) if by else writer).trigger(**(trigger or {"availableNow": True})).start()


def stream_aggregates(df: DataFrame, path: str, checkpoint: str, mode: str = "update", kind: str = "parquet", **trigger) -> StreamingQuery:
    """Every batch's changed values, in a folder of the batch's number: a batch that is run again replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").format(kind).save(f"{path}/batch={number}")

    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**(trigger or {"availableNow": True})).start()


def discard(df: DataFrame) -> None:
    """Compute and keep nothing."""
    df.write.format("noop").mode("overwrite").save()
