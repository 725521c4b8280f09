"""What the training-data operators share: scratch tables, word rules, two-level prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset("the of and to in a is that for it as was with be by on not he his are at this from or have an they which you were her she their we been has but had all there if will can der die das und ist von zu den mit des im nicht ein eine auf dem sich als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so le la les de et à un une des du en que est pour qui dans ce il au sur se pas plus par ne avec son sont aux ou mais el los las y una por con para su no lo al del como más pero sus o este sí porque esta entre cuando muy".split())

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_own_dir: list[str] = []
_tables: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="proxjoin-"))
    return _own_dir[0]


def materialize(df: DataFrame, codec: str = "zstd", large_rows: bool = False, batch: int | None = None) -> DataFrame:
    """Write ``df`` to a scratch table and return that table: its lineage is cut and it is computed once.

    ``large_rows`` is for rows of some MB each: every row is a row group, as Parquet's writer looks at a group's size only
    after 100 rows and its reader holds a group's rows together. ``batch`` bounds the rows of the plan's Arrow batches.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    write = df.write.option("compression", codec)
    if large_rows:
        write = write.option("parquet.block.row.count.limit", "1")
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(int(before), batch or int(before))))
    try:
        write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete the scratch tables made so far. Call it only when all results built on them are written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _tables:
        path = jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows of an Arrow batch, since a text may be very long."""
    if int(spark.conf.get(BATCH_ROWS)) > rows:
        spark.conf.set(BATCH_ROWS, str(rows))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, though ``body`` uses it often."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs without white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Add exclusive running sums within ``group`` along (bucket, *order).

    Two passes, so that no task holds a whole group: sums of each (group, bucket) are added up first, then rows
    are ranked inside their bucket. ``group`` and ``bucket`` must be free of nulls.
    """
    names = list(values)
    df = df.withColumns({f"_v_{n}": c for n, c in values.items()})
    totals = df.groupBy(*group, bucket).agg(*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in names])
    up_to = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, bucket, *[F.coalesce(F.sum(f"_b_{n}").over(up_to), F.lit(0)).alias(f"_b_{n}") for n in names])
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(totals, [*group, bucket])
    out = out.withColumns({n: (F.col(f"_b_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0))).cast("long") for n in names})
    return out.drop(*[f"_v_{n}" for n in names], *[f"_b_{n}" for n in names])


def parcel(docs: DataFrame, text: str) -> DataFrame:
    """(_row, _text): all columns but the text in one struct, so that no name can clash with an operator's own."""
    return docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_row"), F.col(f"`{text}`").alias("_text"))


def unparcel(df: DataFrame, like: DataFrame, text: str, size: str | None = None) -> DataFrame:
    """The columns of ``like`` from (_row, _text); column ``size``, if there is one, is the text's new length."""
    kinds = {f.name: f.dataType for f in like.schema}
    row = lambda c: F.col("_row").getField(c)
    return df.select(*[F.col("_text").alias(c) if c == text else F.length("_text").cast(kinds[c]).alias(c) if c == size else row(c).alias(c) for c in like.columns])


def hash_bucket(key: Column, bits: int = 12) -> Column:
    """The upper bits of a 64-bit hash as a bucket number."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int")


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
