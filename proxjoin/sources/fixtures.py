"""Small fixed inputs, and helpers that make streams of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "tupleId string, lat double, lon double, velocity double, time double, onground string, streamId string"

# Eight rows as (id, lat, lon, time).
UNIT_8 = [
    ("T1_S1", 10, 70, 2300), ("T4_S1", 30, 50, 2300), ("T6_S1", 50, 20, 2200), ("T8_S1", 70, 10, 2200),
    ("T2_S2", 10, 60, 2100), ("T5_S2", 50, 30, 2100), ("T3_S3", 20, 60, 2000), ("T7_S3", 60, 20, 2000),
]
# Places that each stream goes round.
ROUNDS = {1: [(10, 70), (30, 50), (50, 20), (70, 10)], 2: [(10, 60), (50, 30)], 3: [(20, 60), (60, 20)]}


def unit_8(spark: SparkSession) -> DataFrame:
    """Velocity is 100 throughout, onground null."""
    return spark.createDataFrame([(i, float(a), float(b), 100.0, float(t), None, f"stream_{i[-1]}") for i, a, b, t in UNIT_8], SCHEMA)


def unit_32(spark: SparkSession) -> DataFrame:
    """16, 8 and 8 rows of three streams; velocity 100, onground true."""
    rows, number = [], 0
    times = {1: [2100] * 8 + [2200] * 8, 2: [2200] + [2300] * 3 + [2100] * 4, 3: [2100] * 8}
    for s, n in ((1, 16), (2, 8), (3, 8)):
        for k in range(n):
            number += 1
            lat, lon = ROUNDS[s][k % len(ROUNDS[s])]
            rows.append((f"T{number}_S{s}", float(lat), float(lon), 100.0, float(times[s][k]), "true", f"stream_{s}"))
    return spark.createDataFrame(rows, SCHEMA)


def random_coordinate(low: float, high: float, seed: int = 0) -> Column:
    """Uniform in [low, high)."""
    return F.rand(seed) * (high - low) + low


def dealt(df: DataFrame, number: str, streams: int = 3) -> DataFrame:
    """Rows dealt to streams in turn by a whole number: streamId is stream_1, stream_2, ..."""
    return df.withColumn("streamId", F.concat(F.lit("stream_"), (F.pmod(F.col(number), F.lit(streams)) + 1).cast("string")))
