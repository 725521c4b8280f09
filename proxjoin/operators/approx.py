"""Approximate counts and sums of the n-way join from per-cell totals, without joining.

For each cell, N is a stream's weight (1 at home and in enclosed cells, else the share of the cell within the radius), R
the part of it from copies, V and U the same weighted with a value of the aggregated stream:
count = sum over cells of (product of N - product of R), sum = likewise with V and U in place of that stream's N and R.
Members of a cell count as independent, so counts lean upwards; averages are close.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxjoin.functions import geometry
from proxjoin.operators import sketch
from proxjoin.operators.aggregate import average
from proxjoin.operators.grid import replicate


def weight(point: Sequence[Column], cells: Sequence[Column], length: float, radius: float, replica: Column, formula: str = "area") -> Column:
    """A copy's weight in its cell by ``area`` fraction or by the edge-point formula (``edges``)."""
    lows, highs = [geometry.low(c, length) for c in cells], [geometry.high(c, length) for c in cells]
    if formula == "area":
        share = geometry.area_fraction(point, lows, length, radius)
    else:
        ratio = geometry.volume_ratio(point, lows, highs, radius, length)
        share = F.when(geometry.intersected(point, lows, highs, radius), ratio).otherwise(F.lit(0.0))
    return F.when(~replica | geometry.enclosed(point, lows, highs, radius), F.lit(1.0)).otherwise(share)


def weighted(streams: dict[str, DataFrame], on: Sequence[str], radius: float, stream: str, field: str, formula: str = "area", length: float | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """(cells, k, isReplica, w, v): every copy with its stream's number, weight, and value where it is aggregated, and the
    row's ``carried`` columns.
    """
    on = sorted(on)
    length = length or geometry.cell_length(radius, len(on))
    keys = [f"cell_{i}" for i in range(len(on))]
    parts = []
    for k, (name, df) in enumerate(streams.items()):
        point = [F.col(f"`{a}`").cast("double") for a in on]
        copies = replicate(df.dropna(subset=on), point, length, radius, prefix="cell_")
        w = weight(point, [F.col(c) for c in keys], length, radius, F.col("isReplica"), formula)
        v = F.coalesce(F.col(f"`{field}`").cast("double"), F.lit(0.0)) if name == stream else F.lit(0.0)
        parts.append(copies.select(*keys, F.lit(k).alias("k"), "isReplica", w.alias("w"), v.alias("v"), *carried))
    return reduce(DataFrame.unionByName, parts)


def by_lines(copies: DataFrame, point: Sequence[Column], cells: Sequence[Column], length: float, radii: Sequence[float], steps: int = geometry.STEPS) -> DataFrame:
    """Copies whose weights are to be added up, as rows whose ``_w_<j>`` add up to ``steps`` ** axes times the weight for the
    j-th of ascending radii.

    A copy at home or in an enclosed cell is one row, one that the largest radius doesn't reach none, any other a row for
    each line of the cell's points: all lines in one expression would be a method too large for the JVM to compile.
    """
    lows, highs, n = [geometry.low(c, length) for c in cells], [geometry.high(c, length) for c in cells], len(point)
    row = lambda whole, line: F.struct(F.lit(whole).alias("_whole"), *[F.lit((k + 0.5) * length / steps).alias(f"_line_{j}") for j, k in enumerate(line)])
    lines = F.array(*[row(False, line) for line in product(range(steps), repeat=n - 1)])
    whole = ~F.col("isReplica") | geometry.enclosed(point, lows, highs, radii[0])
    met = copies.where(whole | (geometry.box_squared(point, lows, highs) < F.lit(radii[-1] ** 2)))
    out = met.select("*", F.inline(F.when(whole, F.array(row(True, (0,) * (n - 1)))).otherwise(lines)))
    at, weights = [F.col(f"_line_{j}") for j in range(n - 1)], {}
    for j, r in enumerate(radii):
        some = F.when(geometry.enclosed(point, lows, highs, r), F.lit(steps)).otherwise(geometry.points_of_line(point, lows, at, length, r, steps))
        weights[f"_w_{j}"] = F.when(F.col("_whole"), F.lit(steps**n)).otherwise(some).cast("double")
    return out.withColumns(weights).drop("_whole", *[f"_line_{j}" for j in range(n - 1)])


def cell_totals(streams: dict[str, DataFrame], on: Sequence[str], radius: float, stream: str, field: str, formula: str = "area", length: float | None = None) -> DataFrame:
    """(cells, N_k and R_k for the k-th stream, V, U): partial sums first, then one row for each cell that a weight reaches."""
    on, keys, unit = sorted(on), [f"cell_{i}" for i in range(len(on))], 1.0
    if formula == "area":
        length, unit, parts = length or geometry.cell_length(radius, len(on)), float(geometry.STEPS ** len(on)), []
        for k, (name, df) in enumerate(streams.items()):
            v = F.coalesce(F.col(f"`{field}`").cast("double"), F.lit(0.0)) if name == stream else F.lit(0.0)
            narrow = df.dropna(subset=on).select(*[F.col(f"`{a}`").cast("double").alias(f"_x_{i}") for i, a in enumerate(on)], v.alias("v"))
            point = [F.col(f"_x_{i}") for i in range(len(on))]
            copies = by_lines(replicate(narrow, point, length, radius, prefix="cell_"), point, [F.col(c) for c in keys], length, [radius])
            parts.append(copies.select(*keys, F.lit(k).alias("k"), "isReplica", F.col("_w_0").alias("w"), "v"))
        rows = reduce(DataFrame.unionByName, parts)
    else:
        rows = weighted(streams, on, radius, stream, field, formula, length)
    only = lambda c, cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0.0)) / F.lit(unit)
    aggs, w, v = [], F.col("w"), F.col("w") * F.col("v")
    for k in range(len(streams)):
        aggs += [only(w, F.col("k") == k).alias(f"N_{k}"), only(w, (F.col("k") == k) & F.col("isReplica")).alias(f"R_{k}")]
    a = list(streams).index(stream)
    aggs += [only(v, F.col("k") == a).alias("V"), only(v, (F.col("k") == a) & F.col("isReplica")).alias("U")]
    return rows.groupBy(*keys).agg(*aggs)


def sketched_totals(streams: dict[str, DataFrame], on: Sequence[str], radius: float, stream: str, field: str, formula: str = "area", buckets: int = 1 << 14, rows: int = 3) -> DataFrame:
    """The same totals as point queries of two Count-Min sketches, of weights and of weighted values.

    Keys are ``cell_stream`` and, for copies, ``cell_stream_replica``. What is kept of all rows is two sketches of a fixed
    size; totals are never below the true ones for weights and values from 0.
    """
    copies = weighted(streams, on, radius, stream, field, formula)
    keys = [f"cell_{i}" for i in range(len(on))]
    cell, a = F.concat_ws(":", *keys), list(streams).index(stream)
    named = lambda replica: sketch.composite_key(cell, F.col("k").cast("string"), replica)
    both = F.array(F.struct(named(F.lit(False)).alias("key")), F.struct(F.when(F.col("isReplica"), named(F.lit(True))).alias("key")))
    entries = copies.select("k", "w", "v", F.inline(both)).where("key IS NOT NULL")
    counts = sketch.create(entries, F.col("key"), F.col("w"), buckets, rows)
    sums = sketch.create(entries.where(F.col("k") == a), F.col("key"), F.col("w") * F.col("v"), buckets, rows)
    of = [(f"{n}_{k}", k, n == "R") for k in range(len(streams)) for n in ("N", "R")]
    asked = copies.select(*keys).distinct().select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("k"), F.lit(r).alias("r")) for n, k, r in of])))
    asked = asked.withColumn("key", sketch.composite_key(cell, F.col("k").cast("string"), F.col("r")))
    got = asked.join(sketch.query(counts, asked, "key", buckets, rows).withColumnRenamed("estimate", "w"), "key")
    got = got.join(sketch.query(sums, asked.where(F.col("k") == a), "key", buckets, rows).withColumnRenamed("estimate", "v"), "key", "left")
    pick = [F.max(F.when(F.col("name") == n, F.col("w"))).alias(n) for n, _, _ in of]
    return got.groupBy(*keys).agg(*pick, F.max(F.when(F.col("name") == f"N_{a}", F.col("v"))).alias("V"), F.max(F.when(F.col("name") == f"R_{a}", F.col("v"))).alias("U"))


def per_cell(cells: DataFrame, n: int, a: int) -> DataFrame:
    """A cell's estimated count and sum."""
    prod = lambda name, skip=-1: reduce(mul, [F.col(f"{name}_{k}") for k in range(n) if k != skip], F.lit(1.0))
    return cells.withColumn("joinCount", prod("N") - prod("R")).withColumn("joinSum", F.col("V") * prod("N", a) - F.col("U") * prod("R", a))


def _summed(cells: DataFrame, query_id: str | None) -> DataFrame:
    out = cells.agg(F.coalesce(F.sum("joinCount"), F.lit(0.0)).alias("joinCount"), F.coalesce(F.sum("joinSum"), F.lit(0.0)).alias("joinSum"))
    out = out.withColumn("joinAvg", average(F.col("joinSum"), F.col("joinCount")))
    return out.select(F.lit(query_id).alias("queryId"), "*") if query_id else out


def estimate(streams: dict[str, DataFrame], on: Sequence[str], radius: float, stream: str, field: str, formula: str = "area", query_id: str | None = None, by_sketch: bool = False) -> DataFrame:
    """joinCount, joinSum, joinAvg over all cells, from their exact totals or from sketches."""
    totals = (sketched_totals if by_sketch else cell_totals)(streams, on, radius, stream, field, formula)
    return _summed(per_cell(totals, len(streams), list(streams).index(stream)), query_id)


@dataclass(frozen=True)
class Asked:
    """A query of a group: its streams, and the stream and field of its sum."""

    id: str
    radius: float
    names: tuple[str, ...]
    stream: str
    field: str


BITS = "_queries"
MOST = 62


def bit(i: int, bits: str | Column = BITS) -> Column:
    """The i-th query's bit is set in a bitmap."""
    return (F.col(bits) if isinstance(bits, str) else bits).bitwiseAND(F.lit(1 << i)) != 0


def group_totals(streams: dict[str, DataFrame], on: Sequence[str], asked: Sequence[Asked], formula: str = "area") -> DataFrame:
    """(cells, and for the i-th query N_i_k, R_i_k, V_i, U_i): the totals of all queries of a group from one set of copies.

    Rows of all streams, each with the bitmap ``_queries`` of the queries that it takes part in, are copied once, for the
    largest radius, over the cells of the least; a copy has a weight for each radius, null where that doesn't reach its cell.
    A query alone needs its own columns only, and Spark leaves out the others' weights and sums.
    """
    if len(asked) > MOST:
        raise ValueError(f"a bitmap holds {MOST} queries, not {len(asked)}")
    on, fields, radii = sorted(on), sorted({q.field for q in asked}), sorted({q.radius for q in asked})
    length, keys = geometry.cell_length(radii[0], len(on)), [f"cell_{i}" for i in range(len(on))]
    value = lambda df, f: F.col(f"`{f}`").cast("double") if f in df.columns else F.lit(None).cast("double")
    parts = []
    for name, df in streams.items():
        axes = [F.col(f"`{a}`").cast("double") for a in on]
        rows = df.dropna(subset=on).where(reduce(and_, [F.abs(x) < float("inf") for x in axes]))
        parts.append(rows.select(*[x.alias(f"_x_{i}") for i, x in enumerate(axes)], F.lit(name).alias("_stream"), BITS, *[value(df, f).alias(f"_v_{j}") for j, f in enumerate(fields)]))
    point = [F.col(f"_x_{i}") for i in range(len(on))]
    copies = replicate(reduce(DataFrame.unionByName, parts), point, length, radii[-1], prefix="cell_")
    cells, unit = [F.col(c) for c in keys], 1.0
    if formula == "area":
        copies, unit = by_lines(copies, point, cells, length, radii), float(geometry.STEPS ** len(on))
    else:
        lows, highs = [geometry.low(c, length) for c in cells], [geometry.high(c, length) for c in cells]
        copies = copies.withColumns({f"_w_{j}": geometry.radius_weight(point, lows, highs, length, F.col("isReplica"), r, formula) for j, r in enumerate(radii)})
    only = lambda c, cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0.0)) / F.lit(unit)
    aggs = []
    for i, q in enumerate(asked):
        w = F.col(f"_w_{radii.index(q.radius)}")
        for k, name in enumerate(q.names):
            of = (F.col("_stream") == name) & bit(i)
            aggs += [only(w, of).alias(f"N_{i}_{k}"), only(w, of & F.col("isReplica")).alias(f"R_{i}_{k}")]
        of, v = (F.col("_stream") == q.stream) & bit(i), w * F.col(f"_v_{fields.index(q.field)}")
        aggs += [only(v, of).alias(f"V_{i}"), only(v, of & F.col("isReplica")).alias(f"U_{i}")]
    return copies.groupBy(*keys).agg(*aggs)


def of_group(totals: DataFrame, i: int, q: Asked) -> DataFrame:
    """The i-th query's estimate from its group's totals."""
    own = [F.col(f"{n}_{i}_{k}").alias(f"{n}_{k}") for n in "NR" for k in range(len(q.names))]
    cells = totals.select(*own, F.col(f"V_{i}").alias("V"), F.col(f"U_{i}").alias("U"))
    return _summed(per_cell(cells, len(q.names), q.names.index(q.stream)), q.id)


def estimate_group(streams: dict[str, DataFrame], on: Sequence[str], asked: Sequence[Asked], formula: str = "area") -> DataFrame:
    """queryId, joinCount, joinSum, joinAvg of all queries of a group in one plan: one set of copies, one shuffle of cells."""
    sums = []
    for i, q in enumerate(asked):
        a, n = q.names.index(q.stream), range(len(q.names))
        prod = lambda name, skip=-1, i=i, n=n: reduce(mul, [F.col(f"{name}_{i}_{k}") for k in n if k != skip], F.lit(1.0))
        sums += [F.sum(prod("N") - prod("R")).alias(f"c_{i}"), F.sum(F.col(f"V_{i}") * prod("N", a) - F.col(f"U_{i}") * prod("R", a)).alias(f"s_{i}")]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(q.id).alias("queryId"), zero(f"c_{i}").alias("joinCount"), zero(f"s_{i}").alias("joinSum")) for i, q in enumerate(asked)])
    out = group_totals(streams, on, asked, formula).agg(*sums).select(F.inline(rows))
    return out.withColumn("joinAvg", average(F.col("joinSum"), F.col("joinCount")))


def same_cell(streams: dict[str, DataFrame], on: Sequence[str], length: float, stream: str, field: str) -> DataFrame:
    """Per-cell products without copies: cells, one count for each stream (n_k), joinCount, joinSum."""
    on = sorted(on)
    keys = [f"cell_{i}" for i in range(len(on))]
    parts = []
    for k, (name, df) in enumerate(streams.items()):
        cells = [geometry.cell_of(F.col(f"`{a}`").cast("double"), length).alias(c) for a, c in zip(on, keys, strict=True)]
        parts.append(df.dropna(subset=on).select(*cells, F.lit(k).alias("k"), (F.col(f"`{field}`").cast("double") if name == stream else F.lit(None).cast("double")).alias("v")))
    n, a = len(streams), list(streams).index(stream)
    counts = [F.sum((F.col("k") == k).cast("long")).alias(f"n_{k}") for k in range(n)]
    out = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*counts, F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
    product = reduce(mul, [F.col(f"n_{k}") for k in range(n)])
    rest = reduce(mul, [F.col(f"n_{k}") for k in range(n) if k != a])
    return out.select(*keys, *[f"n_{k}" for k in range(n)], product.alias("joinCount"), (F.col("v") * rest).alias("joinSum")).where("joinCount > 0")
