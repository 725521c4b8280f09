"""Clusters instead of cells: k-means, nearest centroids, centroids, radii."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxjoin.functions import distance as D
from proxjoin.sources.scratch import stored


def kmeans(df: DataFrame, on: Sequence[str], k: int, iterations: int = 20, kind: str = "euclidean", seed: int = 42) -> list[list[float]]:
    """Centroids. Cosine clusters unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    axes = [F.col(f"`{a}`").cast("double") for a in sorted(on)]
    axes = D.normalise(axes) if kind == "cosine" else axes
    names = [f"_x{i}" for i in range(len(axes))]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(df.dropna(subset=list(on)).select(*[x.alias(n) for n, x in zip(names, axes, strict=True)]))
    if kind == "cosine":
        rows = rows.where(" OR ".join(f"{n} <> 0" for n in names))
    model = KMeans(k=k, maxIter=iterations, seed=seed, distanceMeasure=kind).fit(rows)
    return [[float(x) for x in c] for c in model.clusterCenters()]


def assign(df: DataFrame, on: Sequence[str], centroids: Sequence[Sequence[float]], kind: str = "euclidean", normalise: bool = False) -> DataFrame:
    """Rows with clusterId and centroidDistance of the nearest centroid; the first of equally near ones."""
    near, axes = D.distance(kind), [F.col(f"`{a}`").cast("double") for a in sorted(on)]
    axes = D.normalise(axes) if normalise else axes
    options = [F.struct(near(axes, [F.lit(float(x)) for x in c]).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)]
    best = F.array_min(F.array(*options))
    return df.withColumn("_best", best).withColumn("clusterId", F.col("_best.i")).withColumn("centroidDistance", F.col("_best.d")).drop("_best")


def fixed_start_kmeans(df: DataFrame, on: Sequence[str], centroids: Sequence[Sequence[float]], rounds: int, kind: str = "euclidean") -> list[list[float]]:
    """Centroids after so many rounds of assignment and recomputing, or when none moves, from given ones.

    A cluster without members keeps its centroid. The driver holds the centroids only.
    """
    now, on = [[float(x) for x in c] for c in centroids], sorted(on)
    for _ in range(rounds):
        moved = {r.clusterId: [r[a] for a in on] for r in recompute(assign(df.dropna(subset=on), on, now, kind, kind == "cosine"), on).collect()}
        after = [moved.get(i, c) for i, c in enumerate(now)]
        if after == now:
            break
        now = after
    return now


def windowed(df: DataFrame, on: Sequence[str], window: str, k: int, iterations: int = 20, kind: str = "euclidean", seed: int = 42) -> DataFrame:
    """Rows with clusterId and the cluster's centroid on each axis, where every window (a column) has clusters of its own.

    Windows are clustered side by side, all of them in one job for each round: their centroids are a table of a row for
    each window and cluster. First centroids are the window's k rows of the least hash.
    """
    on = sorted(on)
    rows = df.dropna(subset=on)
    axes = [F.col(f"`{a}`").cast("double") for a in on]
    axes = D.normalise(axes) if kind == "cosine" else axes
    point = F.array(*axes)
    rows = rows.withColumns({"_p": point, "_h": F.xxhash64(F.lit(seed), *on)})
    nth = F.row_number().over(Window.partitionBy(window).orderBy("_h", "_p"))
    first = rows.select(window, "_h", "_p").distinct().withColumn("_n", nth).where(F.col("_n") <= k)
    heads = first.groupBy(window).agg(F.array_sort(F.collect_list(F.struct("_n", "_p"))).alias("f"))  # k rows of a window
    heads = stored(heads.select(window, F.transform("f", lambda x: x["_p"]).alias("_c")))

    def nearest(c: Column) -> Column:
        d = lambda m: F.aggregate(F.zip_with("_p", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
        return F.array_min(F.transform(c, lambda m, i: F.struct(d(m).alias("d"), i.alias("i"))))["i"]

    for _ in range(iterations):
        placed = rows.join(heads, window).withColumn("clusterId", nearest(F.col("_c")))
        means = placed.groupBy(window, "clusterId").agg(F.array(*[F.avg(F.col("_p")[j]) for j in range(len(on))]).alias("m"))
        moved = means.groupBy(window).agg(F.map_from_entries(F.collect_list(F.struct("clusterId", "m"))).alias("m"))
        heads = stored(heads.join(moved, window).select(window, F.transform("_c", lambda c, i: F.coalesce(F.try_element_at("m", i), c)).alias("_c")))
    out = rows.join(heads, window).withColumn("clusterId", nearest(F.col("_c")))
    return out.withColumns({f"centroid_{a}": F.get(F.get("_c", F.col("clusterId")), F.lit(j)) for j, a in enumerate(on)}).drop("_c", "_p", "_h")


def recompute(assigned: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each cluster's mean on every axis."""
    return assigned.groupBy("clusterId").agg(*[F.avg(F.col(f"`{a}`").cast("double")).alias(a) for a in sorted(on)])


def radius(assigned: DataFrame) -> DataFrame:
    """Each cluster's farthest member."""
    return assigned.groupBy("clusterId").agg(F.max("centroidDistance").alias("radius"))
