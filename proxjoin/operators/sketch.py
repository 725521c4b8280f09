"""Count-Min and front-counter sketches as DataFrames.

A sketch is a table of (row, bucket, value). Its size is rows times buckets, whatever is counted, so it may be
broadcast. Cells are double, and each row hashes the key anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, ROWS, SLOTS, FRONT = 10, 3, 10_000, 3


def bucket(row: Column, key: Column, buckets: int) -> Column:
    """From the first 32 bits of the MD5 of ``row#key``."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", row.cast("string"), key.cast("string"))), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def composite_key(cell: Column, stream: Column, replica: Column | None = None) -> Column:
    """``cell_stream``, and ``cell_stream_replica`` for copies."""
    key = F.concat_ws("_", cell, stream)
    return key if replica is None else F.when(replica, F.concat(key, F.lit("_replica"))).otherwise(key)


def _check(buckets: int, rows: int) -> None:
    if buckets <= 0 or rows <= 0:
        raise ValueError("a sketch needs buckets and rows above 0")


def _with_rows(df: DataFrame, key: Column, buckets: int, rows: int) -> DataFrame:
    return df.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("bucket", bucket(F.col("row"), key, buckets))


def create(df: DataFrame, key: Column, value: Column | None = None, buckets: int = BUCKETS, rows: int = ROWS) -> DataFrame:
    """(row, bucket, value): values added to the key's bucket in every row; 1 for each input row by default.

    Cells are summed where rows lie first, so a task sends rows times buckets numbers at most, and keys aren't shuffled.
    """
    _check(buckets, rows)
    added = df.select(key.alias("key"), (F.lit(1.0) if value is None else value.cast("double")).alias("v"))
    return _with_rows(added, F.col("key"), buckets, rows).groupBy("row", "bucket").agg(F.sum("v").alias("value"))


def merge(sketches: Sequence[DataFrame]) -> DataFrame:
    """Sketches of the same size added up."""
    out = sketches[0]
    for x in sketches[1:]:
        out = out.unionByName(x)
    return out.groupBy("row", "bucket").agg(F.sum("value").alias("value"))


def query(sketch: DataFrame, keys: DataFrame, key: str = "key", buckets: int = BUCKETS, rows: int = ROWS) -> DataFrame:
    """Each key's estimate: the least of its cells, 0 for a cell without values. Never below the truth for values from 0."""
    _check(buckets, rows)
    at = _with_rows(keys.select(F.col(key).alias("key")).distinct(), F.col("key"), buckets, rows)
    met = at.join(F.broadcast(sketch), ["row", "bucket"], "left")  # rows times buckets at most
    return met.groupBy("key").agg(F.min(F.coalesce("value", F.lit(0.0))).alias("estimate"))


def reset(sketch: DataFrame, keys: DataFrame, key: str = "key", buckets: int = BUCKETS, rows: int = ROWS) -> DataFrame:
    """The keys' cells set to 0."""
    at = _with_rows(keys.select(F.col(key).alias("key")).distinct(), F.col("key"), buckets, rows).select("row", "bucket").distinct().withColumn("gone", F.lit(True))
    return sketch.join(at, ["row", "bucket"], "left").select("row", "bucket", F.when(F.col("gone"), F.lit(0.0)).otherwise(F.col("value")).alias("value"))


def total(sketch: DataFrame) -> DataFrame:
    """All that was added, counted in one row of the sketch."""
    return sketch.where("row = 0").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("n"))


def density(sketch: DataFrame, buckets: int = BUCKETS, rows: int = ROWS) -> DataFrame:
    """Share of cells that aren't 0."""
    return sketch.agg((F.count_if(F.col("value") != 0) / F.lit(buckets * rows)).alias("density"))


def slot(key: Column, slots: int = SLOTS) -> Column:
    return bucket(F.lit("front"), key, slots)


def front_counts(df: DataFrame, key: Column, value: Column | None = None, slots: int = SLOTS) -> DataFrame:
    """(key, adds, total): what was added for each key."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("adds"), F.sum(F.lit(1.0) if value is None else value.cast("double")).alias("total"))


def panakos_of(counted: DataFrame, buckets: int = BUCKETS, rows: int = ROWS, slots: int = SLOTS) -> DataFrame:
    """Estimates for keys from their adds (key, adds), see ``panakos_query``."""
    counted = counted.withColumn("slot", slot(F.col("key"), slots))
    front = counted.groupBy("slot").agg(F.sum("adds").alias("all"))
    beyond = counted.join(front, "slot").withColumn("over", F.col("adds") * F.greatest(F.col("all") - FRONT, F.lit(0)) / F.col("all"))
    behind = create(beyond.where("over > 0"), F.col("key"), F.col("over"), buckets, rows)
    guess = query(behind, counted, "key", buckets, rows)
    out = counted.join(front, "slot").join(guess, "key")
    return out.select("key", F.when(F.col("all") <= FRONT, F.col("all").cast("double")).otherwise(FRONT + F.col("estimate")).alias("estimate"))


def panakos_query(df: DataFrame, key: Column, buckets: int = BUCKETS, rows: int = ROWS, slots: int = SLOTS) -> DataFrame:
    """Counts by a front counter that holds up to 3 for each slot, with what is beyond in a Count-Min sketch."""
    return panakos_of(front_counts(df, key), buckets, rows, slots)


def panakos_removed(df: DataFrame, key: Column, gone: Column, buckets: int = BUCKETS, rows: int = ROWS, slots: int = SLOTS) -> DataFrame:
    """The counts where rows for which ``gone`` is true take one back instead of adding one: front counter and sketch
    hold what is left, as if the rows taken back had never come. Keys of which nothing is left have no row.
    """
    left = df.groupBy(key.alias("key")).agg(F.sum(F.when(gone, F.lit(-1)).otherwise(F.lit(1))).alias("adds")).where("adds > 0")
    return panakos_of(left, buckets, rows, slots)


def panakos_compat(adds: Column, value: Column) -> Column:
    """What the counter first published with this sketch gives for one key after ``adds`` adds of ``value``."""
    return F.when(adds < FRONT, adds.cast("double")).otherwise(FRONT - 1 + (adds - FRONT) * F.floor(value))
