"""Where intermediate results go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and the driver is the only machine."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="proxjoin-"))
    return _own[0]


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table of the shared folder: computed once, with its lineage cut."""
    path = f"{folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
