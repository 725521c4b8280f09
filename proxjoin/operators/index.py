"""A stored index over one-dimensional keys: searches, inserts, deletes, and a join of probe intervals.

A row's key is the number of its nearest centroid times ``SPREAD``, plus its distance to it. Rows are written in ranges of
the key and sorted by it inside each file, with row groups small enough that a filter on the key skips most of them. What
is added later is a further version, sorted like the first; a deletion is a version with the ids that go, and takes
effect on rows of versions up to its own, so an id can be inserted again. Nothing is written twice: readers see the
versions that are complete.

The join asks, for each probe and each cluster that its radius reaches, for the interval of keys that ``search_bounds``
gives. Intervals and rows meet in bins of the key as wide as the radius; the interval, and then the distance, decide.
Before that, the probes' least and greatest bounds in each cluster are put on the scan, where they skip row groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proxjoin.functions import distance as D
from proxjoin.operators.join import _axes, _prefixed, _within, cosine_search_bounds, index_range, join_id, search_bounds

#: Keys of a cluster lie in a range of its own, so no distance to a centroid may reach this far.
SPREAD = 1_000_000.0
#: Bytes of a row group.
GROUP = 1 << 20


class StoredIndex:
    """The index in the folder ``path``, over the axes ``on``, by ``centroids`` (of unit vectors, for cosine)."""

    def __init__(self, spark: SparkSession, path: str, on: Sequence[str], centroids: Sequence[Sequence[float]], kind: str = "euclidean", id_col: str = "tupleId", group_bytes: int = GROUP):
        if kind not in ("euclidean", "cosine"):
            raise ValueError(f"no index keys for {kind}")
        self.spark, self.path, self.on, self.kind, self.id_col, self.group_bytes = spark, path, sorted(on), kind, id_col, group_bytes
        self.centroids = [[float(v) for v in c] for c in centroids]

    # Versions

    def _exists(self, name: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _next(self) -> int:
        n = 0
        while self._exists(f"rows/version={n}/_SUCCESS") or self._exists(f"deleted/version={n}/_SUCCESS"):
            n += 1
        return n

    def _places(self, axes: Sequence[Column]) -> list[Column]:
        return D.normalise(axes) if self.kind == "cosine" else list(axes)

    def keyed(self, df: DataFrame) -> DataFrame:
        """Rows with cluster and key; rows with a null or a number that isn't finite on an axis, or a zero vector under
        cosine, have no partners and no key, and are left out. A distance of ``SPREAD`` or more is an error.
        """
        axes = [F.col(f"`{a}`").cast("double") for a in self.on]
        df = df.dropna(subset=self.on).where(reduce(and_, [F.abs(x) < float("inf") for x in axes]))
        if self.kind == "cosine":
            df = df.where(reduce(or_, [x != 0 for x in axes]))
        near = F.array_min(F.array(*[F.struct(D.euclidean(self._places(axes), [F.lit(v) for v in c]).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(self.centroids)]))
        placed = df.withColumn("_near", near)
        far = F.raise_error(F.lit(f"a row is farther than {SPREAD} from every centroid")).cast("double")
        key = F.when(F.col("_near.d") < SPREAD, F.col("_near.k") * F.lit(SPREAD) + F.col("_near.d")).otherwise(far)
        return placed.withColumn("cluster", F.col("_near.k")).withColumn("key", key).drop("_near")

    def insert(self, df: DataFrame) -> None:
        """Add rows, as a version of their own. Rows that are there already are kept beside them."""
        rows = self.keyed(df).repartitionByRange("key").sortWithinPartitions("key")
        rows.write.mode("overwrite").option("parquet.block.size", self.group_bytes).option("parquet.page.size", self.group_bytes // 8).parquet(f"{self.path}/rows/version={self._next()}")

    def delete(self, ids: DataFrame) -> None:
        """Take out the rows whose id is among ``ids``, as they are now."""
        ids.select(self.id_col).distinct().write.mode("overwrite").parquet(f"{self.path}/deleted/version={self._next()}")

    def rows(self, keep: Column | None = None) -> DataFrame:
        """What the index holds; ``keep`` is a condition on keys that goes to the scan."""
        held = self.spark.read.parquet(f"{self.path}/rows")
        held = held if keep is None else held.where(keep)
        if not self._exists("deleted"):
            return held.drop("version")
        gone = self.spark.read.parquet(f"{self.path}/deleted").groupBy(F.col(self.id_col).alias("_gone")).agg(F.max("version").alias("_until"))
        taken = (F.col(f"`{self.id_col}`") == F.col("_gone")) & (F.col("version") <= F.col("_until"))
        return held.join(gone, taken, "left_anti").drop("version")

    # Searches

    def range(self, low: float, high: float, include: str = "both") -> DataFrame:
        """Rows whose key lies in a range; see ``index_range``."""
        return index_range(self.rows(F.col("key").between(low, high)), low, high, include)

    def radii(self) -> dict[int, float]:
        """Each cluster's radius: its farthest row's distance, deleted ones included."""
        held = self.spark.read.parquet(f"{self.path}/rows")
        return {r.cluster: r.far for r in held.groupBy("cluster").agg((F.max("key") - F.first("cluster") * F.lit(SPREAD)).alias("far")).collect()}  # a row for each centroid

    def _bounds(self, axes: Sequence[Column], radius: float, radii: dict[int, float]) -> Column:
        """(cluster, low, high) of every cluster that a sphere around the point reaches."""
        found = []
        wide = radius * (1 + 1e-9)
        for k, far in sorted((radii or {0: 0.0}).items()):
            spread = D.euclidean(self._places(axes), [F.lit(v) for v in self.centroids[k]])
            slack = 1e-9 * (far + 1) + k * SPREAD * 1e-15  # keys are rounded
            bounds = (cosine_search_bounds if self.kind == "cosine" else search_bounds)(wide, F.lit(far + slack), F.lit(k), spread, SPREAD)
            found.append(F.when(bounds[0].isNotNull(), F.struct(F.lit(k).alias("cluster"), (bounds[0] - slack).alias("low"), (bounds[1] + slack).alias("high"))))
        return F.filter(F.array(*found), lambda b: b.isNotNull())

    def near(self, point: Sequence[float], radius: float) -> DataFrame:
        """Rows within the radius of a point: a range of keys for each cluster in reach, then the distance."""
        axes = [F.lit(float(v)) for v in point]
        radii = self.radii()
        if not radii:
            return self.rows()
        bounds = self.spark.range(1).select(F.inline(self._bounds(axes, radius, radii))).collect()  # clusters in reach
        some = reduce(or_, [F.col("key").between(b.low, b.high) for b in bounds], F.lit(False))
        own = [F.col(f"`{a}`").cast("double") for a in self.on]
        return self.rows(some).where(D.distance(self.kind)(axes, own) <= F.lit(float(radius)))

    def join(self, probes: DataFrame, radius: float, names: tuple[str, str] = ("a", "b")) -> DataFrame:
        """Pairs within the radius of a probe and a row of the index, as wide rows ``<name>__<column>`` with joinId."""
        if radius <= 0 or self.kind == "cosine" and radius >= 1:
            raise ValueError("an index join needs a radius above 0, and below 1 for cosine")
        a, b = names
        width = D.cosine_as_euclidean(radius) if self.kind == "cosine" else float(radius)
        left = _prefixed(probes.dropna(subset=self.on), a)
        axes = _axes(a, self.on)
        left = left.where(reduce(and_, [F.abs(x) < float("inf") for x in axes]))
        if self.kind == "cosine":
            left = left.where(reduce(or_, [x != 0 for x in axes]))
        asked = left.select("*", F.inline(self._bounds(axes, radius, self.radii())))
        reached = asked.groupBy("cluster").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()  # a row for each centroid
        some = reduce(or_, [F.col("key").between(r.low, r.high) for r in reached], F.lit(False))
        bin_of = lambda key: F.floor(key / F.lit(width))
        asked = asked.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("low")), bin_of(F.col("high"))))).drop("cluster")
        right = _prefixed(self.rows(some), b).withColumn("_bin", bin_of(F.col(f"{b}__key")))
        met = asked.join(right, "_bin").where(F.col(f"{b}__key").between(F.col("low"), F.col("high")) & _within([a], b, self.on, radius, self.kind))
        return met.drop("_bin", "low", "high", f"{b}__key", f"{b}__cluster").withColumn("joinId", join_id([a, b], self.id_col))
