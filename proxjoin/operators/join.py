"""N-way similarity joins: every combination of one row of each stream in which all pairs are within a radius."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations
from math import isqrt
from operator import add, and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxjoin.functions import distance as D
from proxjoin.functions import geometry
from proxjoin.operators.grid import COUNTED, copy_counts, crowded_cells, dealt, replicate
from proxjoin.sources import scratch

SEP = "__"
#: Tasks for each core that compare all pairs, and how often two divides the rows of a block of the nested loop.
SHARES, RUN = 4, 9


def _prefixed(df: DataFrame, stream: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{stream}{SEP}{c}") for c in df.columns])


def _axes(stream: str, on: Sequence[str]) -> list[Column]:
    return [F.col(f"`{stream}{SEP}{a}`").cast("double") for a in on]


def join_id(streams: Sequence[str], id_col: str) -> Column:
    """Members' ids in order as text, joined by ``-``."""
    return F.concat_ws("-", F.array_sort(F.array(*[F.col(f"`{s}{SEP}{id_col}`").cast("string") for s in streams])))


def _within(done: Sequence[str], new: str, on: Sequence[str], radius: float, kind: str) -> Column:
    near = D.distance(kind)
    return reduce(and_, [near(_axes(s, on), _axes(new, on)) <= F.lit(float(radius)) for s in done])


def within_all(names: Sequence[str], on: Sequence[str], radius: float, kind: str) -> Column:
    """All pairs of a combination's members are within the radius."""
    return reduce(and_, [_within(names[:k], name, sorted(on), radius, kind) for k, name in enumerate(names) if k])


def _span(streams: Sequence[str], band: tuple[str, int]) -> Column:
    """Sequence numbers of all members within a window of that many rows."""
    at = [F.col(f"`{s}{SEP}{band[0]}`") for s in streams]
    return F.greatest(*at) - F.least(*at) < F.lit(band[1])


def clique_join(
    streams: dict[str, DataFrame], on: Sequence[str], radius: float, kind: str = "euclidean", id_col: str = "tupleId",
    r_min: float | None = None, r_max: float | None = None, ring: str = "full", band: tuple[str, int] | None = None, salt: int = 1,
    rows_per_part: int | None = None,
) -> DataFrame:
    """Combinations as wide rows: ``<stream>__<column>`` and joinId.

    The distance predicate becomes an equi-join on grid cells with the distance as residual. Rows are copied to greater
    cells only, and a combination counts where one member is at home: its greatest home cell, so it comes once. Cosine
    below 1 is joined on unit vectors. ``salt`` spreads the first stream's rows of a cell over that many partitions;
    ``band`` (column, width) keeps combinations whose column differs by less than the width. Nulls and numbers
    that aren't finite on an axis join nothing. A join of one stream has no combinations.

    With ``rows_per_part`` cells follow the density: a first count of cells, stored in the shared folder, finds those where a
    stream has more rows, and deals all streams' rows there into parts of about that many. A cell's rows are near one
    another, so smaller cells would save no comparison, and would not help where many rows share one point; parts do.
    Rows with equal ids and axes stay together.
    """
    names, on = list(streams), sorted(on)
    if len(names) < 2:
        raise ValueError("a join needs two streams or more")
    if rows_per_part is not None and (rows_per_part < 1 or salt > 1):
        raise ValueError("rows_per_part is 1 or more, and takes the place of salt")
    if kind not in ("euclidean", "cosine") or kind == "cosine" and radius >= 1:
        return nested_loop_join(streams, on, radius, kind, id_col, band)
    reach = D.cosine_as_euclidean if kind == "cosine" else float
    low, top = reach(r_min if r_min is not None else radius), reach(r_max if r_max is not None else radius)
    if low <= 0:
        raise ValueError("a grid needs a radius above 0")
    length = geometry.cell_length(low, len(on))
    keys = [f"_cell_{i}" for i in range(len(on) + (band is not None))]
    placed = []
    for name, df in streams.items():
        df = _prefixed(df.dropna(subset=list(on)), name)
        axes = _axes(name, on)
        df = df.where(reduce(and_, [F.abs(x) < float("inf") for x in axes]))
        if kind == "cosine":
            df, axes = df.where(reduce(lambda a, b: a | b, [x != 0 for x in axes])), D.normalise(axes)
        placed.append((name, df, (axes, length, top, ring, "_cell_", (F.col(f"`{name}{SEP}{band[0]}`"), band[1]) if band else None)))
    crowded = None
    if rows_per_part is not None:
        crowded = scratch.stored(crowded_cells([copy_counts(df, *where) for _, df, where in placed], keys, rows_per_part))
    out: DataFrame | None = None
    for k, (name, df, where) in enumerate(placed):
        copies = replicate(df, *where).withColumnRenamed("isReplica", f"_rep_{k}")
        if crowded is not None:
            copies = dealt(copies, crowded, keys, k, F.xxhash64(f"`{name}{SEP}{id_col}`", *where[0]))
        if salt > 1:
            part = F.pmod(F.xxhash64(f"`{name}{SEP}{id_col}`"), F.lit(salt)).cast("int") if k == 0 else F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))
            copies = copies.withColumn("_salt", part)
        if out is None:
            out = copies
            continue
        # Spark takes the copies for as small as the rows that they are made of, and would send them to the driver.
        out = out.join(copies.hint("merge"), keys + ["_salt"] * (salt > 1) + ["_part"] * (crowded is not None)).where(_within(names[:k], name, on, radius, kind))
        if band:
            out = out.where(_span(names[: k + 1], band))
    copied = [f"_rep_{k}" for k in range(len(names))]
    out = out.where(~reduce(and_, [F.col(c) for c in copied]))
    return out.drop(*keys, *copied, "_salt", "_part").withColumn("joinId", join_id(names, id_col))


def nested_loop_join(streams: dict[str, DataFrame], on: Sequence[str], radius: float, kind: str = "euclidean", id_col: str = "tupleId", band: tuple[str, int] | None = None) -> DataFrame:
    """The same by comparing all pairs: the baseline, and for distances without a grid.

    The first stream's rows are dealt to ``SHARES`` tasks a core, each of which reads the others' rows one by one: a small
    table is one file's part, and would be one task. Comparisons grow with the product of the streams' sizes.
    """
    names, on = list(streams), sorted(on)
    first = streams[names[0]]
    out = _prefixed(first.dropna(subset=list(on)).repartition(SHARES * first.sparkSession.sparkContext.defaultParallelism), names[0])
    for k, name in enumerate(names[1:], 1):
        near = _within(names[:k], name, on, radius, kind)
        out = out.join(_prefixed(streams[name].dropna(subset=list(on)), name), near & _span(names[: k + 1], band) if band else near)
    return out.withColumn("joinId", join_id(names, id_col))


def _blocks(df: DataFrame, axes: Sequence[Column], own: Column) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_block``, runs of at most ``1 << RUN`` rows that lie near one another, and the blocks' boxes; both stored.

    Rows are sorted by strips along the first axis and within a strip along the others, by ranges that also part equal rows.
    """
    count = df.count()
    strips = max(1, isqrt(count >> RUN))
    bounds = df.select(axes[0].alias("v")).approxQuantile("v", [i / strips for i in range(1, strips)], 0.001) if strips > 1 else []
    strip = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < axes[0])) if bounds else F.lit(0)
    keys = ["_strip", *[f"_place_{i}" for i in range(1, len(axes))], "_place_0", "_own"]
    rows = df.withColumns({"_strip": strip, "_own": own} | {f"_place_{i}": x for i, x in enumerate(axes)})
    rows = rows.repartitionByRange(max(1, -(-count // COUNTED)), *keys).sortWithinPartitions(*keys)
    # A partition's rows are numbered from a multiple of 2 ** 33.
    rows = scratch.stored(rows.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), RUN)).drop("_strip", "_own"))
    ends = [f(f"_place_{i}").alias(f"_{name}_{i}") for i in range(len(axes)) for name, f in (("low", F.min), ("high", F.max))]
    return rows.drop(*[f"_place_{i}" for i in range(len(axes))]), scratch.stored(rows.groupBy("_block").agg(*ends))


def block_nested_loop_join(streams: dict[str, DataFrame], on: Sequence[str], radius: float, id_col: str = "tupleId") -> DataFrame:
    """The nested loop within a Euclidean radius, over blocks first: all pairs of blocks' boxes are compared, then all pairs of
    rows of those blocks whose boxes lie within the radius.

    The distance of two boxes is computed as that of two rows, from differences that are no greater than the rows', so it is
    no greater than any of theirs, rounding included. A row is shipped once for each block near its own, and a task holds a
    block. Where boxes keep nothing apart, comparisons still grow with the product of the streams' sizes.
    """
    names, on = list(streams), sorted(on)
    tasks = SHARES * streams[names[0]].sparkSession.sparkContext.defaultParallelism
    placed = []
    for name, df in streams.items():
        axes = _axes(name, on)
        finite = reduce(and_, [F.abs(x) < float("inf") for x in axes])  # distances to others are within no radius
        placed.append(_blocks(_prefixed(df.dropna(subset=list(on)), name).where(finite), axes, F.xxhash64(f"`{name}{SEP}{id_col}`")))
    gap = lambda i: F.greatest(F.col(f"_low_{i}") - F.col(f"_top_{i}"), F.col(f"_bottom_{i}") - F.col(f"_high_{i}"), F.lit(0.0))
    apart = F.sqrt(reduce(add, [gap(i) * gap(i) for i in range(len(on))]))
    mine = placed[0][1].withColumnsRenamed({"_block": "_first"} | {f"_low_{i}": f"_bottom_{i}" for i in range(len(on))} | {f"_high_{i}": f"_top_{i}" for i in range(len(on))}).repartition(tasks)
    out = placed[0][0].withColumnRenamed("_block", "_first")
    for k, (name, (rows, boxes)) in enumerate(zip(names, placed, strict=True)):
        if k == 0:
            continue
        near = scratch.stored(mine.join(boxes, apart <= F.lit(float(radius))).select("_first", "_block"))
        met = out.join(near, "_first").repartition(tasks, "_block").join(rows.repartition(tasks, "_block").hint("merge"), "_block")
        out = met.where(_within(names[:k], name, on, radius, "euclidean")).drop("_block")
    return out.drop("_first").withColumn("joinId", join_id(names, id_col))


def cell_only_join(streams: dict[str, DataFrame], on: Sequence[str], radius: float, id_col: str = "tupleId") -> DataFrame:
    """Combinations within one cell, without any distance: a cell's diagonal is the radius, so all are near."""
    names, on = list(streams), sorted(on)
    length = geometry.cell_length(radius, len(on))
    keys = [f"_cell_{i}" for i in range(len(on))]
    parts = [_prefixed(df.dropna(subset=list(on)), n).withColumns({k: geometry.cell_of(x, length) for k, x in zip(keys, _axes(n, on), strict=True)}) for n, df in streams.items()]
    return reduce(lambda a, b: a.join(b.hint("merge"), keys), parts).drop(*keys).withColumn("joinId", join_id(names, id_col))


def long_form(wide: DataFrame, streams: Sequence[str], fields: Sequence[str], query_id: str | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """A row for each member of a combination: its fields, streamId, joinId, isExpired (false, unless it is ``carried``)."""
    rows = F.array(*[F.struct(*[F.col(f"`{s}{SEP}{f}`").alias(f) for f in fields], F.lit(s).alias("streamId")) for s in streams])
    out = wide.select("joinId", *carried, F.inline(rows))
    out = out if "isExpired" in carried else out.withColumn("isExpired", F.lit(False))
    return out.withColumn("queryId", F.lit(query_id)) if query_id else out


def unjoined(streams: dict[str, DataFrame], wide: DataFrame, id_col: str = "tupleId") -> DataFrame:
    """Rows (id, streamId) that no combination holds."""
    parts = []
    for name, df in streams.items():
        used = wide.select(F.col(f"`{name}{SEP}{id_col}`").alias(id_col)).distinct()
        parts.append(df.join(used.hint("merge"), id_col, "left_anti").select(id_col, F.lit(name).alias("streamId")))
    return reduce(DataFrame.unionByName, parts)


def distance_band_join(a: DataFrame, b: DataFrame, on: Sequence[str], radius: float, pivots: Sequence[Sequence[float]], id_col: str = "tupleId") -> DataFrame:
    """Pairs within the radius by distance to pivots: rows meet in a band of distances, as wide as the radius, to ``b``'s
    nearest pivot. A row of ``a`` goes to every pivot that may be nearest to a partner, and there to the three bands
    that its distance reaches; that follows from the triangle inequality, so no pair is lost.
    """
    on = sorted(on)

    def ranked(df: DataFrame, name: str) -> DataFrame:
        axes = _axes(name, on)
        reach = [F.struct(D.euclidean(axes, [F.lit(float(v)) for v in p]).alias("d"), F.lit(k).alias("pivot")) for k, p in enumerate(pivots)]
        return _prefixed(df.dropna(subset=list(on)), name).withColumn("_all", F.array(*reach)).withColumn("_near", F.array_min("_all"))

    left = ranked(a, "a")
    width = radius * (1 + 1e-9)
    left = left.select("*", F.inline(F.filter("_all", lambda p: p["d"] <= F.col("_near.d") + F.lit(2 * width)))).withColumnRenamed("d", "_da").drop("_all", "_near")
    home = F.floor(F.col("_da") / F.lit(width))
    left = left.withColumn("band", F.explode(F.array(home - 1, home, home + 1)))
    right = ranked(b, "b").select("*", F.col("_near.d").alias("_db"), F.col("_near.pivot").alias("pivot")).drop("_all", "_near")
    right = right.withColumn("band", F.floor(F.col("_db") / F.lit(width)))
    near = (F.abs(F.col("_da") - F.col("_db")) <= F.lit(radius * (1 + 1e-9))) & (D.euclidean(_axes("a", on), _axes("b", on)) <= F.lit(float(radius)))
    return left.join(right, ["pivot", "band"]).where(near).drop("_da", "_db", "pivot", "band").withColumn("joinId", join_id(["a", "b"], id_col))


def search_bounds(radius: float, cluster_radius: Column, position: Column, spread: Column, c: float = 1_000_000.0) -> tuple[Column, Column]:
    """One-dimensional keys that may hold partners of a point at ``spread`` from the centre of cluster ``position``.

    Null bounds: the point's sphere doesn't reach the cluster.
    """
    reached = spread - F.lit(radius) <= cluster_radius
    base = position.cast("double") * F.lit(c)
    return F.when(reached, base + F.greatest(spread - F.lit(radius), F.lit(0.0))), F.when(reached, base + F.least(cluster_radius, spread + F.lit(radius)))


def cosine_search_bounds(radius: float, cluster_radius: Column, position: Column, spread: Column, c: float = 1_000_000.0) -> tuple[Column, Column]:
    """The same for a cosine radius below 1, with distances between unit vectors."""
    return search_bounds(D.cosine_as_euclidean(radius), cluster_radius, position, spread, c)


def index_keys(df: DataFrame, on: Sequence[str], pivots: Sequence[Sequence[float]], c: float = 1_000_000.0, name: str = "key") -> DataFrame:
    """Rows with the one-dimensional key of an index: nearest pivot's position times ``c``, plus the distance to it."""
    axes = [F.col(f"`{a}`").cast("double") for a in sorted(on)]
    near = F.array_min(F.array(*[F.struct(D.euclidean(axes, [F.lit(float(v)) for v in p]).alias("d"), F.lit(k).alias("k")) for k, p in enumerate(pivots)]))
    return df.dropna(subset=list(on)).withColumn("_near", near).withColumn(name, F.col("_near.k") * F.lit(c) + F.col("_near.d")).drop("_near")


def index_range(indexed: DataFrame, low: float, high: float, include: str = "both", name: str = "key") -> DataFrame:
    """Rows whose key lies in a range; ``include`` says which of its ends are part of it: both, low, high, none. A point
    is a range of one key. On a table that is stored in order of its key, the filter reaches the scan.
    """
    if include not in ("both", "low", "high", "none"):
        raise ValueError(f"unknown ends {include!r}")
    key = F.col(name)
    over = key >= low if include in ("both", "low") else key > low
    return indexed.where(over & (key <= high if include in ("both", "high") else key < high))


#: Vectors of a block that are compared at once, and the blocks that a table is dealt into until they are full.
AT_ONCE, BLOCKS = 1024, 16


def tile(kind: str, radius: float, at_once: int = AT_ONCE) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The comparison of a pair of blocks (i, j): rows (id, v, own), own being their block; so many rows of each at a time."""

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x, ids, own = np.stack(group["v"].to_list()), group["id"].to_numpy(), group["own"].to_numpy()
        n = np.sqrt((x * x).sum(axis=1))
        if kind == "cosine":
            some = n > 0
            x, ids, n, own = x[some], ids[some], n[some], own[some]
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]

        def meet(a: np.ndarray, b: np.ndarray) -> None:
            dot = x[a] @ x[b].T
            # Within one block a pair comes in both orders; between two, once.
            met = (ids[a][:, None] < ids[b]) if key[0] == key[1] else (ids[a][:, None] != ids[b])
            if kind == "cosine":
                every = 1 - np.maximum(0.0, dot / np.outer(n[a], n[b]))
                p, q = np.nonzero((every <= radius) & met)
                d = every[p, q]
            else:
                # The product cancels for vectors far from the origin: it only leaves out pairs that no rounding could bring near.
                squares = (n[a] ** 2)[:, None] + n[b] ** 2
                p, q = np.nonzero((squares - 2 * dot <= radius**2 + 4 * (x.shape[1] + 4) * np.finfo(float).eps * squares) & met)
                d = np.concatenate([np.zeros(0), *[np.sqrt(((x[a[p[k : k + 65_536]]] - x[b[q[k : k + 65_536]]]) ** 2).sum(axis=1)) for k in range(0, len(p), 65_536)]])
                p, q, d = p[d <= radius], q[d <= radius], d[d <= radius]
            for kept, some in zip(found, (ids[a][p], ids[b][q], d), strict=True):
                kept.append(some)

        mine, others = np.flatnonzero(own == key[0]), np.flatnonzero(own == key[1])
        for i in range(0, len(mine), at_once):
            for j in range(0, len(others), at_once):
                meet(mine[i : i + at_once], others[j : j + at_once])
        left, right, d = (np.concatenate(f) for f in found)
        return pd.DataFrame({"id_a": np.minimum(left, right), "id_b": np.maximum(left, right), "distance": d})

    return compare


def array_pairs(df: DataFrame, vector: str, radius: float, id_col: str = "id", kind: str = "cosine", block: int = 32_768) -> DataFrame:
    """(id_a, id_b, distance) with id_a < id_b of rows of array vectors within the radius, by pairs of blocks.

    Rows are dealt by a hash of the id to ``BLOCKS`` blocks, or as many as hold about ``block`` rows each; a pair of blocks is
    a key, so a task holds two blocks at a time, whatever the data, and compares them by matrix products of parts. All
    vectors must have one length; rows without a vector have no pairs. Zero vectors are at cosine distance 1 from all. A
    row is shipped once for each block: ``BLOCKS`` times up to ``BLOCKS`` * ``block`` rows, and from there on in proportion to the
    table. The comparisons grow with its square: this is for radii at which nothing can be left out.
    """
    if kind == "cosine" and radius >= 1:
        raise ValueError("within a cosine distance of 1 everything matches")
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    count = rows.count()
    blocks = max(1, min(BLOCKS, -(-count // AT_ONCE)), -(-count // block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    dealt = rows.withColumn("own", own).select("id", "v", "own", F.inline(met))

    return dealt.groupBy("i", "j").applyInPandas(tile(kind, radius), "id_a long, id_b long, distance double")


def pairs_of(streams: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(streams, 2))
