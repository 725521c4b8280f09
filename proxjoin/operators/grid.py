"""The grid: rows get their cell, and copies in the greater cells that their radius reaches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxjoin.functions import geometry

LAST = 1 << 62
#: Rows that a task copies and counts: it holds a count for each cell of each copy.
COUNTED = 100_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt to partitions of at most about ``COUNTED`` of its ``rows`` rows, by hash of ``keys`` if there are any.

    The number is a part of the plan, as partitions that Spark merges or reads by their bytes hold many times that as copies.
    """
    return df.repartition(max(1, -(-rows // COUNTED)), *keys)


def cells(df: DataFrame, axes: Sequence[Column], length: float, prefix: str = "cell_") -> DataFrame:
    return df.withColumns({f"{prefix}{i}": geometry.cell_of(x, length) for i, x in enumerate(axes)})


def _steps(axes: int, length: float, r_max: float, ring: str, banded: bool, prune: bool) -> list[tuple[int, ...]]:
    steps = geometry.offsets(r_max, length, axes, ring, ordered=not banded, prune=prune)
    if banded:
        steps = [(*o, b) for o in steps for b in (-1, 0, 1)]
        steps = [o for o in steps if (sum(o), *o) >= (0,) * (len(o) + 1)]
    return steps


def _home(axes: Sequence[Column], length: float, band: tuple[Column, int] | None) -> list[Column]:
    # Cells have room for offsets on both sides; what lies beyond shares the last one, where distances decide.
    home = [F.greatest(F.least(geometry.cell_of(x, length), F.lit(LAST)), F.lit(-LAST)) for x in axes]
    return home if band is None else [*home, F.floor(band[0] / F.lit(band[1])).cast("bigint")]


def replicate(df: DataFrame, axes: Sequence[Column], length: float, r_max: float, ring: str = "full", prefix: str = "cell_", band: tuple[Column, int] | None = None, prune: bool = True) -> DataFrame:
    """Rows with their cells and ``isReplica``, a copy for each offset.

    ``band`` is one more axis with cells of its own width, for whole numbers that may differ by less than that width.
    The offsets are a constant list, so copying is one Generate without a shuffle.
    """
    steps, home = _steps(len(axes), length, r_max, ring, band is not None, prune), _home(axes, length, band)
    names = [f"{prefix}{i}" for i in range(len(home))]
    rows = F.array(*[F.struct(*[F.lit(x).alias(f"_o{i}") for i, x in enumerate(o)]) for o in steps])
    out = df.withColumns({f"_h{i}": h for i, h in enumerate(home)}).select("*", F.inline(rows))
    out = out.withColumns({n: F.col(f"_h{i}") + F.col(f"_o{i}") for i, n in enumerate(names)})
    replica = F.lit(False)
    for i in range(len(home)):
        replica = replica | (F.col(f"_o{i}") != 0)
    return out.withColumn("isReplica", replica).drop(*[f"_h{i}" for i in range(len(home))], *[f"_o{i}" for i in range(len(home))])


def reached(place: Column, reach: float, length: float) -> Column:
    """The cells along an axis that ``reach`` on both sides of a place touches: two at most where cells are over twice as long."""
    at = lambda x: F.greatest(F.least(geometry.cell_of(x, length), F.lit(LAST)), F.lit(-LAST))
    low, high = at(place - F.lit(reach)), at(place + F.lit(reach))
    return F.when(low == high, F.array(low)).otherwise(F.sequence(low, high))


def copy_counts(df: DataFrame, axes: Sequence[Column], length: float, r_max: float, ring: str = "full", prefix: str = "cell_", band: tuple[Column, int] | None = None, prune: bool = True) -> DataFrame:
    """(cells, n): how many copies ``replicate`` makes in each cell. Home cells are counted and their counts copied, no row is.

    There are no more home cells than rows, so these bound what a task copies.
    """
    steps = _steps(len(axes), length, r_max, ring, band is not None, prune)
    home = {f"_h{i}": h for i, h in enumerate(_home(axes, length, band))}
    counted = df.groupBy(*[h.alias(n) for n, h in home.items()]).agg(F.count("*").alias("n"))
    counted = spread(counted, df.count(), *home)
    rows = F.array(*[F.struct(*[F.lit(x).alias(f"_o{i}") for i, x in enumerate(o)]) for o in steps])
    cells = [(F.col(n) + F.col(f"_o{i}")).alias(f"{prefix}{i}") for i, n in enumerate(home)]
    return counted.select("*", F.inline(rows)).groupBy(*cells).agg(F.sum("n").alias("n"))


def crowded_cells(counts: Sequence[DataFrame], keys: Sequence[str], most: int) -> DataFrame:
    """(cells, p_0, p_1, ...): the parts into which a cell's rows of each stream are dealt, ``most`` rows in each on average.

    Listed are cells where a stream has more than that, so there are fewer of them than copies / ``most``. All are 0 where a
    stream has no row: nothing can come of such a cell.
    """
    rows = reduce(DataFrame.unionByName, [c.select(*keys, F.lit(k).alias("k"), "n") for k, c in enumerate(counts)])
    cells = rows.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(f"_n_{k}") for k in range(len(counts))])
    n = [F.col(f"_n_{k}") for k in range(len(counts))]
    parts = [F.when(F.least(*n) > 0, F.ceil(c / F.lit(most))).otherwise(F.lit(0)).cast("bigint").alias(f"p_{k}") for k, c in enumerate(n)]
    return cells.where(F.greatest(*n) > F.lit(most)).select(*keys, *parts)


def dealt(copies: DataFrame, crowded: DataFrame, keys: Sequence[str], k: int, own: Column) -> DataFrame:
    """The k-th stream's copies with ``_part``; in a crowded cell a copy for each part that its row belongs to.

    A crowded cell's parts are the cells of a table with an axis for each stream. A row has its place on its own stream's
    axis by the hash ``own`` and is copied along the others, so members of a combination meet in exactly one part.
    """
    sides = [c for c in crowded.columns if c not in keys]
    p = [F.coalesce(F.col(c), F.lit(1)) for c in sides]
    product = lambda of: reduce(mul, of, F.lit(1).cast("bigint"))
    out = copies.join(crowded, list(keys), "left").where(p[0] > 0)
    out = out.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("bigint"), product(p[:k] + p[k + 1 :]) - 1)))
    before = product(p[:k])
    inner = F.col("_t") % before
    return out.withColumn("_part", inner + F.pmod(own, p[k]) * before + (F.col("_t") - inner) * p[k]).drop("_t", *sides)


def exchange(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows of a key in one partition (fields grouping). Without keys, rows are dealt evenly (shuffle grouping)."""
    if not keys:
        return df.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
