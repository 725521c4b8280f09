"""Counts and sums over combinations without making them.

Rows meet in tiles several radii wide: the first stream's at home only, the others' in each tile that their radius reaches,
so every combination is counted in one tile. In a tile, rows are put in runs of near ones with their bounding boxes. Runs
whose boxes lie wholly within the radius of one another count by the product of their sizes, runs that are too far apart
not at all, and only what is left has its distances computed, by the same formula as in the join. Three streams count by a
product of matrices: how often a pair of the second and third stream shares a partner in the first.

Tiles with more than ``PART`` rows of a stream are cut into parts, and parts of the streams meet in groups of bounded
size, so a point that holds a third of all rows is many tasks.

Pairs of two streams within a cosine radius in the plane need no tiles: a row's partners are a range of angles, and counts
of ranges are differences of running counts along the sorted angles. Only pairs so near the radius that rounding decides
meet and have their distances computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from math import asin, pi, sqrt
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxjoin.functions import distance as D
from proxjoin.operators.aggregate import average, totals
from proxjoin.operators.join import clique_join
from proxjoin.sources.scratch import stored

#: Rows of a stream in a group at most (about), rows of a run, and pairs of runs whose distances are computed at once.
PART, RUN, PAIRS = 8192, 128, 128
#: A tile's side in radii.
WIDE = 8
#: Boxes decide only where rounding can't: by this share of the radius, and as much of 1 for cosine.
SLACK = 1e-9
#: How far a computed cosine distance or angle may be from the true one, with room to spare.
ROUNDED = 1e-14


def _euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = 0.0
    for i in range(a.shape[-1]):
        gap = a[..., i] - b[..., i]
        total = total + gap * gap
    return np.sqrt(total)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = lambda x: sum(x[..., i] * x[..., i] for i in range(x.shape[-1]))
    dot = sum(a[..., i] * b[..., i] for i in range(a.shape[-1]))
    return 1 - np.maximum(0.0, dot / (np.sqrt(squares(a)) * np.sqrt(squares(b))))


class Rows:
    """A stream's rows of a group, in runs: places (for boxes), points (for distances), values."""

    def __init__(self, place: np.ndarray, point: np.ndarray, value: np.ndarray, length: float):
        order = np.lexsort([*place.T[::-1], *np.floor(place / length).T[::-1]]) if len(place) else np.zeros(0, int)
        self.place, self.point, self.value = place[order], point[order], value[order]
        self.starts = np.arange(0, len(place), RUN)
        self.sizes = np.diff(np.r_[self.starts, len(place)])
        if len(place):
            self.low, self.high = np.minimum.reduceat(self.place, self.starts), np.maximum.reduceat(self.place, self.starts)

    def sums(self) -> np.ndarray:
        return np.add.reduceat(self.value, self.starts, axis=0)

    def run(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of runs, and which are past their end."""
        at = self.starts[i][:, None] + np.arange(RUN)
        past = np.arange(RUN) >= self.sizes[i][:, None]
        return np.minimum(at, len(self.place) - 1), past


def _boxes(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the least and greatest distances of two streams' runs."""
    near = np.maximum(np.maximum(a.low[:, None] - b.high, b.low - a.high[:, None]), 0)
    far = np.maximum(a.high[:, None] - b.low, b.high - a.low[:, None])
    return (near * near).sum(axis=2), (far * far).sum(axis=2)


def count_pairs(a: Rows, b: Rows, radius: float, reach: float, near: Callable) -> tuple[int, np.ndarray, np.ndarray]:
    """Pairs within the radius, and sums of both sides' values over them."""
    least, most = _boxes(a, b)
    whole = most < (reach * (1 - SLACK)) ** 2 - SLACK * reach**2
    some = ~whole & (least <= (reach * (1 + SLACK)) ** 2)
    count = int((np.outer(a.sizes, b.sizes) * whole).sum())
    of_a, of_b = (whole @ b.sizes) @ a.sums(), (a.sizes @ whole) @ b.sums()
    i, j = np.nonzero(some)
    for k in range(0, len(i), PAIRS):
        p, no_p = a.run(i[k : k + PAIRS])
        q, no_q = b.run(j[k : k + PAIRS])
        hit = near(a.point[p][:, :, None], b.point[q][:, None]) <= radius
        hit &= ~no_p[:, :, None] & ~no_q[:, None]
        count += int(hit.sum())
        if a.value.shape[1]:
            of_a = of_a + np.einsum("ij,ijk->k", hit.sum(axis=2), a.value[p])
        if b.value.shape[1]:
            of_b = of_b + np.einsum("ij,ijk->k", hit.sum(axis=1), b.value[q])
    return count, of_a, of_b


def count_triples(a: Rows, b: Rows, c: Rows, radius: float, reach: float, near: Callable) -> tuple[int, list[np.ndarray]]:
    """Cliques of three, run by run of the first stream, and sums of each side's values over them."""
    count, sums = 0, [np.zeros(r.value.shape[1]) for r in (a, b, c)]
    close = [_boxes(a, r)[0] <= (reach * (1 + SLACK)) ** 2 for r in (b, c)]
    members = [np.repeat(np.arange(len(r.starts)), r.sizes) for r in (b, c)]
    for i, start in enumerate(a.starts):
        rows = slice(start, start + a.sizes[i])
        point = a.point[rows][:, None]
        at_b, at_c = (np.flatnonzero(k[i][m]) for k, m in zip(close, members, strict=True))
        with_b, with_c = near(point, b.point[at_b]) <= radius, near(point, c.point[at_c]) <= radius
        at_b, with_b = at_b[with_b.any(axis=0)], with_b[:, with_b.any(axis=0)].astype(np.float64)
        at_c, with_c = at_c[with_c.any(axis=0)], with_c[:, with_c.any(axis=0)].astype(np.float64)
        for k in range(0, len(at_b), RUN):
            part, mine = at_b[k : k + RUN], with_b[:, k : k + RUN]
            both = near(b.point[part][:, None], c.point[at_c]) <= radius
            shared = (mine.T @ with_c) * both
            count += int(shared.sum())
            if sums[1].size:
                sums[1] += shared.sum(axis=1) @ b.value[part]
            if sums[2].size:
                sums[2] += shared.sum(axis=0) @ c.value[at_c]
            if sums[0].size:
                sums[0] += ((mine @ both) * with_c).sum(axis=1) @ a.value[rows]
    return count, sums


def _upto(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of sorted places ``t`` with weights ``w`` and signs ``s``: its first place, the sums of both, and the sum of
    each sign times the weights up to there.
    """
    first, held, signs, found = None, 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        w, s = batch.column("w").to_numpy(), batch.column("s").to_numpy()
        first = batch.column("t")[0].as_py() if first is None else first
        found += int((s * (held + np.cumsum(w))).sum())
        held, signs = held + int(w.sum()), signs + int(s.sum())
    if first is not None:
        yield pa.RecordBatch.from_pydict({"t": pa.array([first], pa.float64()), "w": pa.array([held], pa.int64()), "s": pa.array([signs], pa.int64()), "n": pa.array([found], pa.int64())})


def plane_pairs(a: DataFrame, b: DataFrame, on: Sequence[str], radius: float) -> DataFrame:
    """One row: ``count`` of the pairs of finite rows of two axes within a cosine ``radius`` below 1.

    Equal points are one with a weight. A task holds a batch of the sorted angles, and a pair near the radius. Work grows
    as that of a sort, however many pairs there are. Rows whose squares are beyond a double join nothing.
    """
    inner = max(0.0, 2 * asin(sqrt(max(0.0, radius - ROUNDED) / 2)) - ROUNDED)
    outer = 2 * asin(sqrt(min(1.0, (radius + ROUNDED) / 2))) + ROUNDED
    sides = []
    for k, df in enumerate((a, b)):
        x, y = (F.col(f"`{c}`").cast("double") for c in on)
        norm = x * x + y * y
        sides.append(df.where((norm > 0) & (norm < float("inf"))).select(F.lit(k).alias("k"), x.alias("x"), y.alias("y")))
    points = stored(sides[0].unionByName(sides[1]).groupBy("k", "x", "y").agg(F.count("*").alias("n")).withColumn("t", F.atan2("y", "x")))
    mine, t = points.where("k = 0"), F.col("t")
    around = F.array(t, *[F.when(t * sign < outer - pi, t + sign * 2 * pi) for sign in (1, -1)])
    others = points.where("k = 1").withColumn("t", F.explode(F.filter(around, lambda c: c.isNotNull())))
    ends = F.array(F.struct((t + inner).alias("t"), F.col("n").alias("s")), F.struct((t - inner).alias("t"), (-F.col("n")).alias("s")))
    none = F.lit(0).cast("long")
    entries = others.select("t", F.col("n").alias("w"), none.alias("s")).unionByName(mine.select(none.alias("w"), F.inline(ends)))
    # A row at a range's end counts as before it, so weights come first.
    parts = entries.repartitionByRange("t").sortWithinPartitions("t", F.abs("s")).mapInArrow(_upto, "t double, w long, s long, n long")
    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sure = parts.withColumn("n", F.col("n") + F.col("s") * F.coalesce(F.sum("w").over(before), none))
    wide = 2 * (outer - inner)
    cell = lambda c: F.floor(c / F.lit(wide))
    edges = F.array(F.struct((t - outer).alias("low"), (t - inner).alias("high")), F.struct((t + inner).alias("low"), (t + outer).alias("high")))
    reaching = mine.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("n").alias("_n"), F.inline(edges))
    reaching = reaching.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    met = others.withColumn("cell", cell(t)).join(reaching.hint("merge"), "cell").where((t > F.col("low")) & (t <= F.col("high")))
    near = met.where(D.cosine([F.col("_x"), F.col("_y")], [F.col("x"), F.col("y")]) <= F.lit(float(radius)))
    return sure.select("n").unionByName(near.select((F.col("n") * F.col("_n")).alias("n"))).agg(F.coalesce(F.sum("n"), none).alias("count"))


def _touched(place: Column, reach: float, length: float) -> Column:
    """Tiles along an axis that a radius around a place reaches."""
    tile = lambda x: F.floor(x / F.lit(length))
    low, high = tile(place - F.lit(reach)), tile(place + F.lit(reach))
    return F.when(low == high, F.array(low)).otherwise(F.sequence(low, high))


def clique_totals(
    streams: dict[str, DataFrame], on: Sequence[str], radius: float, kind: str = "euclidean", stream: str | None = None, fields: Sequence[str] = (), query_id: str | None = None, id_col: str = "tupleId",
) -> DataFrame:
    """As ``totals(clique_join(...))``: one row of count, and sum and avg of each field of ``stream``.

    For joins of two or three streams by Euclidean distance, or cosine below 1; others are joined. Rows with a null or
    a number that isn't finite on an axis join nothing.
    """
    names, on, fields = list(streams), sorted(on), list(fields)
    if len(names) not in (2, 3) or kind not in ("euclidean", "cosine") or radius <= 0 or kind == "cosine" and radius >= 1:
        return totals(clique_join(streams, on, radius, kind, id_col), stream, fields, query_id)
    n, d = len(names), len(on)
    if kind == "cosine" and n == d == 2 and not fields:
        out = plane_pairs(*streams.values(), on, radius)
        return out.select(F.lit(query_id).alias("queryId"), "*") if query_id else out
    reach = D.cosine_as_euclidean(radius) if kind == "cosine" else float(radius)
    length = WIDE * reach
    tiles, parts = [f"_tile_{i}" for i in range(d)], [f"_part_{k}" for k in range(n)]
    sides = []
    for k, (name, df) in enumerate(streams.items()):
        axes = [F.col(f"`{a}`").cast("double") for a in on]
        finite = reduce(lambda a, b: a & b, [x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) for x in axes])
        df = df.where(finite)
        places = axes
        if kind == "cosine":
            df, places = df.where(reduce(or_, [x != 0 for x in axes])), D.normalise(axes)
        values = [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) if name == stream else F.lit(0.0) for f in fields]
        rows = df.select(F.xxhash64(f"`{id_col}`").alias("_hash"), F.lit(k).alias("_k"), F.array(*places).alias("_place"), F.array(*axes).alias("_point"), F.array(*values).cast("array<double>").alias("_value"))
        for i, t in enumerate(tiles):
            at = F.col("_place")[i]
            rows = rows.withColumn(t, F.floor(at / F.lit(length)) if k == 0 else F.explode(_touched(at, reach * (1 + SLACK), length)))
        sides.append(rows)
    every = reduce(DataFrame.unionByName, sides)
    sizes = every.groupBy(*tiles).agg(*[F.ceil(F.count_if(F.col("_k") == k) / PART).alias(p) for k, p in enumerate(parts)])
    crowded = sizes.where(reduce(or_, [F.col(p) > 1 for p in parts])).withColumnsRenamed({p: f"{p}_n" for p in parts})
    dealt = every.join(crowded, tiles, "left")
    for k, p in enumerate(parts):
        many = F.coalesce(F.col(f"{p}_n"), F.lit(1))
        own = F.array(F.pmod(F.col("_hash"), many))
        dealt = dealt.withColumn(p, F.explode(F.when(F.col("_k") == k, own).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(many - 1, F.lit(0))))))
    near, a = (_cosine if kind == "cosine" else _euclidean), names.index(stream) if stream in names else 0

    def count(group: pa.Table) -> pa.Table:
        which = group.column("_k").to_numpy()
        flat = lambda c, w: group.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(which), w)
        place, point, value = flat("_place", d), flat("_point", d), flat("_value", len(fields))
        rows = [Rows(place[which == k], point[which == k], value[which == k], reach / 2) for k in range(n)]
        found, sums = 0, np.zeros(len(fields))
        if all(len(r.place) for r in rows):
            if n == 2:
                found, *by = count_pairs(*rows, radius, reach, near)
            else:
                found, by = count_triples(*rows, radius, reach, near)
            sums = by[a]
        return pa.table({"n": pa.array([found], pa.int64()), "s": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    counted = dealt.drop("_hash", *[f"{p}_n" for p in parts]).groupBy(*tiles, *parts).applyInArrow(count, "n long, s array<double>")
    sums = [F.coalesce(F.sum(F.get("s", F.lit(j))), F.lit(0.0)).alias("sum" if j == 0 else f"sum_{f}") for j, f in enumerate(fields)]
    out = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), *sums)
    for j, f in enumerate(fields):
        out = out.withColumn("avg" if j == 0 else f"avg_{f}", average(F.col("sum" if j == 0 else f"sum_{f}"), F.col("count")))
    return out.select(F.lit(query_id).alias("queryId"), "*") if query_id else out
