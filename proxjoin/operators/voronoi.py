"""Clusters as the join's partitions: a row belongs to its nearest centroid, and goes to each other centroid whose
territory its radius reaches.

Territories meet at the planes halfway between centroids. If two rows are within the radius and the second belongs to
another centroid, the first is no farther than the radius from the plane between its own centroid and that one, so the
plane's distance decides about copies. The first stream's rows stay at home and the others' are copied, so every
combination is found once, at its first member's home. Where the centroids come from changes the work, never the result.

A territory grows with the table, so its rows don't all meet: they lie in cells a little wider than the radius along the
first two axes, the first stream's rows in their own cell and the others' in that and its neighbours. A ``band`` is an axis of
cells, too, several of its widths long. Where a band holds few rows, as a window of numbered rows does, it needs no other cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import dist
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxjoin.functions import distance as D
from proxjoin.functions import geometry
from proxjoin.operators import cluster
from proxjoin.operators.grid import LAST, reached
from proxjoin.operators.join import _axes, _prefixed, _span, _within, join_id

#: Copies go a little farther than the radius asks, as distances are rounded.
SLACK = 1e-9
#: Sides of cells by the radius: neighbours stay neighbours however quotients are rounded.
WIDER = 1.25
#: Widths of a band in a cell of it, and rows of a band that meet without other cells.
BANDS, FEW = 2, 2000


def _reached(axes: Sequence[Column], centroids: Sequence[Sequence[float]]) -> Column:
    """(distance, number) of each centroid."""
    return F.array(*[F.struct(D.euclidean(axes, [F.lit(float(v)) for v in c]).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)])


def _home(axes: Sequence[Column], centroids: Sequence[Sequence[float]]) -> Column:
    return F.array_min(_reached(axes, centroids))["i"]


def _territories(axes: Sequence[Column], centroids: Sequence[Sequence[float]], reach: float) -> Column:
    """Numbers of the centroids whose territory is within reach; the nearest is one of them."""
    every = _reached(axes, centroids)
    between = F.array(*[F.array(*[F.lit(dist(a, b)) for b in centroids]) for a in centroids])

    def near(home: Column) -> Column:
        apart = lambda c: F.get(F.get(between, home["i"]), c["i"])
        to_plane = lambda c: (c["d"] - home["d"]) * (c["d"] + home["d"]) / (2 * apart(c))
        slack = lambda c: SLACK * (c["d"] + home["d"] + F.lit(reach))
        return F.transform(F.filter(every, lambda c: (c["i"] == home["i"]) | (to_plane(c) <= F.lit(reach) + slack(c) * (c["d"] + home["d"]) / apart(c))), lambda c: c["i"])

    return F.transform(F.array(F.array_min(every)), near)[0]


def _inside(rows: DataFrame, axes: Sequence[Column], reach: float, spread: bool) -> tuple[DataFrame, list[str]]:
    """Rows with their cell (``spread``: a copy for each of its neighbours, too), and the names of the cell's columns."""
    if reach <= 0:
        return rows, []
    names = [f"_at_{i}" for i in range(min(2, len(axes)))]
    own = [F.greatest(F.least(geometry.cell_of(x, reach * WIDER), F.lit(LAST)), F.lit(-LAST)) for x in axes[:2]]
    if not spread:
        return rows.withColumns(dict(zip(names, own, strict=True))), names
    for n, c in zip(names, own, strict=True):
        rows = rows.withColumn(n, F.explode(F.array(c - 1, c, c + 1)))
    return rows, names


def voronoi_join(
    streams: dict[str, DataFrame], on: Sequence[str], radius: float, centroids: Sequence[Sequence[float]], kind: str = "euclidean", id_col: str = "tupleId", band: tuple[str, int] | None = None, salt: int = 1, distinct: bool = False,
) -> DataFrame:
    """Combinations as ``clique_join`` gives them, by the territories of ``centroids`` (of unit vectors, for cosine).

    ``salt`` spreads the first stream's rows of a territory over that many partitions. ``band`` is as in ``clique_join``; ``distinct``
    says that no number of its column comes twice, so a band holds no more rows than its width. Rows with a null or a
    number that isn't finite on an axis, or without a number where there is a band, join nothing.
    """
    names, on = list(streams), sorted(on)
    if len(names) < 2:
        raise ValueError("a join needs two streams or more")
    if kind not in ("euclidean", "cosine") or kind == "cosine" and radius >= 1:
        raise ValueError(f"no territories for {kind} within {radius}")
    reach = D.cosine_as_euclidean(radius) if kind == "cosine" else float(radius)
    places = [list(c) for c in dict.fromkeys(tuple(map(float, c)) for c in centroids)]
    out: DataFrame | None = None
    keys: list[str] = []
    for k, (name, df) in enumerate(streams.items()):
        df = _prefixed(df.dropna(subset=[*on, *([band[0]] if band else [])]), name)
        axes = _axes(name, on)
        df = df.where(~reduce(or_, [F.isnan(x) | (F.abs(x) == float("inf")) for x in axes]))
        if kind == "cosine":
            df, axes = df.where(reduce(or_, [x != 0 for x in axes])), D.normalise(axes)
        rows = df.withColumn("_home", _home(axes, places) if k == 0 else F.explode(_territories(axes, places, reach)))
        rows, cells = (rows, []) if band and distinct and band[1] <= FEW else _inside(rows, axes, reach, k > 0)
        if band:
            rows = rows.withColumn("_band", F.explode(reached(F.col(f"`{name}__{band[0]}`"), band[1] if k else 0, BANDS * band[1])))
            cells = [*cells, "_band"]
        keys = ["_home", *cells] + ["_salt"] * (salt > 1)
        if salt > 1:
            rows = rows.withColumn("_salt", F.pmod(F.xxhash64(f"`{name}__{id_col}`"), F.lit(salt)).cast("int") if k == 0 else F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        if out is None:
            out = rows
            continue
        out = out.join(rows.hint("merge"), keys).where(_within(names[:k], name, on, radius, kind))
        if band:
            out = out.where(_span(names[: k + 1], band))
    return out.drop(*keys).withColumn("joinId", join_id(names, id_col))


def fitted(streams: dict[str, DataFrame], on: Sequence[str], k: int, iterations: int = 20, kind: str = "euclidean", seed: int = 42) -> list[list[float]]:
    """Centroids of all streams' rows together; one place for each group of rows if there are fewer than ``k`` of them."""
    on = sorted(on)
    finite = ~reduce(or_, [F.isnan(F.col(a)) | (F.abs(F.col(a)) == float("inf")) for a in on])
    rows = reduce(DataFrame.unionByName, [df.select(*[F.col(f"`{a}`").cast("double").alias(a) for a in on]).dropna().where(finite) for df in streams.values()])
    if kind == "cosine":
        rows = rows.where(reduce(or_, [F.col(a) != 0 for a in on]))
    return cluster.kmeans(rows, on, k, iterations, kind, seed) if not rows.isEmpty() else [[0.0] * len(on)]


def kmeans_join(streams: dict[str, DataFrame], on: Sequence[str], radius: float, k: int = 16, iterations: int = 20, kind: str = "euclidean", id_col: str = "tupleId", band: tuple[str, int] | None = None, salt: int = 1, distinct: bool = False) -> DataFrame:
    """``voronoi_join`` by clusters fitted to the streams' rows."""
    return voronoi_join(streams, on, radius, fitted(streams, on, k, iterations, kind), kind, id_col, band, salt, distinct)
