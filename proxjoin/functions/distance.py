"""Distances as Catalyst expressions, over scalar axes or over array columns. Other distances can be registered."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Axes = Sequence[Column]


def _total(terms: Sequence[Column]) -> Column:
    return reduce(add, terms)


def euclidean(a: Axes, b: Axes) -> Column:
    return F.sqrt(_total([(x - y) * (x - y) for x, y in zip(a, b, strict=True)]))


def cosine(a: Axes, b: Axes) -> Column:
    """1 - max(0, cos), from 0 to 1; 1 if either vector is zero."""
    norms = F.sqrt(_total([x * x for x in a])) * F.sqrt(_total([y * y for y in b]))
    dot = _total([x * y for x, y in zip(a, b, strict=True)])
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - F.greatest(F.lit(0.0), dot / norms))


DISTANCES: dict[str, Callable[[Axes, Axes], Column]] = {"euclidean": euclidean, "cosine": cosine}


def register(name: str, distance: Callable[[Axes, Axes], Column]) -> None:
    """Add a distance. It joins by nested loop, as no cell size is known for it."""
    DISTANCES[name.lower()] = distance


def distance(name: str) -> Callable[[Axes, Axes], Column]:
    try:
        return DISTANCES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown distance {name!r}; known: {sorted(DISTANCES)}") from None


def normalise(axes: Axes) -> list[Column]:
    """Axes divided by their norm; a zero vector stays."""
    norm = F.sqrt(_total([x * x for x in axes]))
    return [F.when(norm == 0, x).otherwise(x / norm) for x in axes]


def dot_array(a: Column, b: Column, width: int | None = None) -> Column:
    """With a ``width``, unrolled into code that Spark compiles; any length without."""
    if width:
        return _total([F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double") for i in range(width)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm_array(a: Column, width: int | None = None) -> Column:
    return F.sqrt(dot_array(a, a, width))


def euclidean_array(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda t, x: t + x))


def cosine_array(a: Column, b: Column) -> Column:
    norms = norm_array(a) * norm_array(b)
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - F.greatest(F.lit(0.0), dot_array(a, b) / norms))


def normalise_array(a: Column) -> Column:
    norm = norm_array(a)
    return F.when(norm == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / norm))


def cosine_as_euclidean(radius: float) -> float:
    """The radius between unit vectors that takes in all pairs within a cosine distance below 1."""
    if radius >= 1:
        raise ValueError("within a cosine distance of 1 everything matches")
    return (2 * radius) ** 0.5 * (1 + 1e-9)
