"""Cells of a uniform grid, and how spheres meet them, as expressions unrolled over a few axes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product
from math import ceil, sqrt
from operator import add, mul

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Axes = Sequence[Column]
STEPS = 12


def cell_length(r_min: float, dimensions: int) -> float:
    """A cell's diagonal is the least radius, so all points of a cell are within it of one another."""
    return r_min / sqrt(dimensions)


def reach(r_max: float, length: float) -> int:
    """Cells that a radius spans along an axis; a little more, as computed distances may be rounded down to the radius."""
    return ceil(r_max * (1 + 1e-9) / length)


def cell_of(x: Column, length: float) -> Column:
    return F.floor(x / F.lit(length)).cast("bigint")


def low(cell: Column, length: float) -> Column:
    return cell * F.lit(length)


def high(cell: Column, length: float) -> Column:
    return (cell + 1) * F.lit(length)


def centroid(cells: Axes, length: float) -> list[Column]:
    return [(c + 0.5) * F.lit(length) for c in cells]


def key(cells: Axes, length: float) -> Column:
    """The cell's centroid in print."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[c.cast("string") for c in centroid(cells, length)]), F.lit("]"))


def offsets(r_max: float, length: float, dimensions: int, ring: str = "full", ordered: bool = True, prune: bool = True) -> list[tuple[int, ...]]:
    """Offsets of the cells to which a point is copied.

    Cells have a total order by sum of coordinates, then by coordinates; which of two is greater depends on their offset
    alone. ``ordered`` keeps offsets to greater cells and the home cell. ``ring`` ``g-1`` is one ring short.
    """
    g = reach(r_max, length) - (ring == "g-1")
    every = product(range(-g, g + 1), repeat=dimensions)
    kept = [o for o in every if not ordered or (sum(o), *o) >= (0,) * (dimensions + 1)]
    apart = lambda o: sum(max(abs(x) - 1, 0) ** 2 for x in o) * length * length
    return [o for o in kept if not prune or apart(o) <= r_max * r_max * (1 + 1e-9)]


def nth_bounds(points: Sequence[Axes], axis: int) -> tuple[Column, Column]:
    """The least and the greatest coordinate of some points on one axis."""
    on = [p[axis] for p in points]
    return F.least(*on), F.greatest(*on)


def corners(lows: Axes, highs: Axes) -> list[list[Column]]:
    return [list(c) for c in product(*zip(lows, highs, strict=True))]


def farthest_squared(point: Axes, lows: Axes, highs: Axes) -> Column:
    far = [F.greatest(F.abs(a - x), F.abs(b - x)) for x, a, b in zip(point, lows, highs, strict=True)]
    return reduce(add, [d * d for d in far])


def nearest_corner_squared(point: Axes, lows: Axes, highs: Axes) -> Column:
    near = [F.least(F.abs(a - x), F.abs(b - x)) for x, a, b in zip(point, lows, highs, strict=True)]
    return reduce(add, [d * d for d in near])


def box_squared(point: Axes, lows: Axes, highs: Axes) -> Column:
    near = [F.greatest(a - x, F.lit(0.0), x - b) for x, a, b in zip(point, lows, highs, strict=True)]
    return reduce(add, [d * d for d in near])


def enclosed(point: Axes, lows: Axes, highs: Axes, radius: float) -> Column:
    """The farthest corner is within the radius."""
    return farthest_squared(point, lows, highs) < F.lit(radius * radius)


def intersected(point: Axes, lows: Axes, highs: Axes, radius: float, by: str = "box") -> Column:
    """The sphere reaches the cell but doesn't enclose it; ``by`` ``corner`` asks for a corner within the sphere."""
    near = box_squared if by == "box" else nearest_corner_squared
    return (near(point, lows, highs) < F.lit(radius * radius)) & ~enclosed(point, lows, highs, radius)


def sphere_root(point: Axes, fixed: Sequence[Column | None], axis: int, radius: float, sign: int = 1) -> Column:
    """Where the sphere meets the line along ``axis`` through ``fixed``; null if it doesn't."""
    squares = reduce(add, [(f - p) * (f - p) for j, (f, p) in enumerate(zip(fixed, point, strict=True)) if j != axis], F.lit(0.0))
    inside = F.lit(radius * radius) - squares
    return F.when(inside >= 0, point[axis] + sign * F.sqrt(inside))


def edge_points(point: Axes, lows: Axes, highs: Axes, radius: float) -> list[list[tuple[Column, Column]]]:
    """For each axis, its edges' meeting points with the sphere on the positive side, as (coordinate, exists) by axis."""
    out: list[list[list[Column]]] = []
    n = len(point)
    for axis in range(n):
        others = [[(lows[j], highs[j])[k] if j != axis else None for j, k in enumerate(pick)] for pick in product((0, 1), repeat=n) if pick[axis] == 0]
        for fixed in others:
            root = sphere_root(point, fixed, axis, radius)
            there = F.coalesce((root >= lows[axis]) & (root <= highs[axis]), F.lit(False))
            out.append([F.when(there, root if j == axis else fixed[j]) for j in range(n)] + [there, F.lit(axis)])
    return out


def volume_ratio(point: Axes, lows: Axes, highs: Axes, radius: float, length: float) -> Column:
    """Share of the cell within the sphere by the edge-point formula: 1 where no edge is met."""
    n, points = len(point), edge_points(point, lows, highs, radius)
    factors = []
    for i in range(n):
        free = reduce(lambda a, b: a | b, [p[n] for k, p in enumerate(points) if k // (len(points) // n) == i])
        least, most = F.least(*[p[i] for p in points]), F.greatest(*[p[i] for p in points])
        partial = F.when(point[i] > highs[i], F.abs(highs[i] - least)).otherwise(F.abs(most - lows[i]))
        factors.append(F.when(free, partial).otherwise(F.abs(highs[i] - lows[i])))
    return F.abs(reduce(mul, factors) / F.lit(length**n))


def points_of_line(point: Axes, lows: Axes, at: Axes, length: float, radius: float, steps: int) -> Column:
    """How many of a line's ``steps`` points along the last axis lie within the sphere; ``at`` is the line's place on the other axes."""
    step, centre = length / steps, point[-1] - lows[-1]
    off = [lows[j] + a - point[j] for j, a in enumerate(at)]
    half = F.sqrt(F.lit(radius * radius) - reduce(add, [a * a for a in off], F.lit(0.0)))  # NaN where the line misses it
    first = F.greatest(F.ceil((centre - half) / F.lit(step) - 0.5), F.lit(0))
    last = F.least(F.floor((centre + half) / F.lit(step) - 0.5), F.lit(steps - 1))
    return F.when(F.isnan(half), F.lit(0)).otherwise(F.greatest(last - first + 1, F.lit(0)))


def _area_shares(axes: int, length: float, radius: float, steps: int) -> Callable[..., Column]:
    """The share by columns of coordinates, then of the cells' least corners, a batch of rows at a time."""
    step = length / steps

    @F.pandas_udf("double")
    def share(*columns: pd.Series) -> pd.Series:
        point, lows = [c.to_numpy(dtype=float) for c in columns[:axes]], [c.to_numpy(dtype=float) for c in columns[axes:]]
        centre, inside = point[-1] - lows[-1], np.zeros(len(point[0]))
        squares = [[(low + (k + 0.5) * step - x) ** 2 for k in range(steps)] for x, low in zip(point[:-1], lows[:-1], strict=True)]
        with np.errstate(invalid="ignore"):
            for line in product(range(steps), repeat=axes - 1):
                half = np.sqrt(radius * radius - reduce(add, [squares[j][k] for j, k in enumerate(line)], 0.0))  # NaN where the line misses the sphere
                first = np.maximum(np.ceil((centre - half) / step - 0.5), 0)
                last = np.minimum(np.floor((centre + half) / step - 0.5), steps - 1)
                inside += np.nan_to_num(np.maximum(last - first + 1, 0))
        return pd.Series(inside / float(steps**axes))

    return share


def area_fraction(point: Axes, lows: Axes, length: float, radius: float, steps: int = STEPS) -> Column:
    """Share of the cell within the sphere by a regular grid of ``steps`` points along each axis.

    Points lie in lines along the last axis; of each line the sphere holds one run, whose length follows from where the
    line enters and leaves it, so a line is one term and not ``steps``. All lines in one expression would be a method too
    large for the JVM to compile, so they are vector operations over batches of rows.
    """
    return _area_shares(len(point), length, radius, steps)(*point, *lows)


def radius_weight(point: Axes, lows: Axes, highs: Axes, length: float, replica: Column, radius: float, formula: str = "edges") -> Column:
    """A copy's weight for one radius: 1 at home and where the cell is enclosed, its share where the sphere meets it, else null."""
    share = volume_ratio(point, lows, highs, radius, length) if formula == "edges" else area_fraction(point, lows, length, radius)
    return F.when(~replica | enclosed(point, lows, highs, radius), F.lit(1.0)).when(intersected(point, lows, highs, radius), share)


def query_weights(point: Axes, lows: Axes, highs: Axes, length: float, replica: Column, radii: dict[str, float], formula: str = "edges") -> Column:
    """A copy's weight for each query of a group as a map, without an entry where the sphere doesn't reach. A copy made for
    the largest radius serves all queries by it.
    """
    entries = [F.struct(F.lit(name).alias("key"), radius_weight(point, lows, highs, length, replica, r, formula).alias("value")) for name, r in radii.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
