"""Tables and streams from files: parquet, JSON records, and a log of entries with JSON in a field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parse_records(entries: DataFrame, schema: T.StructType, data: str = "data", entry_id: str = "id") -> DataFrame:
    """Entries' JSON as rows of ``schema``, plus tupleId (the entry's id) and streamId.

    Doubles are read as such, anything else as text, so a JSON true becomes ``true``. A missing key or a malformed number is null.
    """
    fields = [f for f in schema.fields if f.name not in ("tupleId", "streamId")]
    raw = F.from_json(F.col(data), T.MapType(T.StringType(), T.StringType()))
    rows = entries.select(F.col(entry_id).cast("string").alias("tupleId"), raw.alias("_m"))
    return rows.select("tupleId", *[F.try_element_at("_m", F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in fields], F.try_element_at("_m", F.lit("streamId")).alias("streamId"))


def json_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream of JSON files, so many in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
