"""A count window over a stream with additions and retractions.

State of one group: the rows of its window, in order of arrival. A new row probes the earlier ones, adds what it
completes, and pushes out the row that falls off, whose combinations are taken back. A group may be all rows (one
global window, as one task) or a key that spreads them (a window for each key). A row's partners are found by one
vector operation over the window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product
from math import dist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "seq bigint, stream array<string>, x array<array<double>>, v array<double>, count bigint, sum double"
OUTPUT = "key string, seq bigint, added bigint, expired bigint, count bigint, sum double, avg double"


def near_combinations(new: tuple[str, list[float], float], window: list[tuple[str, list[float], float]], streams: Sequence[str], radius: float) -> list[list[tuple]]:
    """Combinations of ``new`` with one row of every other stream, all pairs within the radius."""
    others = [s for s in streams if s != new[0]]
    near = [[w for w in window if w[0] == s and dist(w[1], new[1]) <= radius] for s in others]
    return [[new, *c] for c in product(*near) if all(dist(a[1], b[1]) <= radius for i, a in enumerate(c) for b in c[i + 1 :])]


class Window:
    """The last rows, as arrays: stream (below 0 where a row joins nothing), point, value."""

    def __init__(self, streams: Sequence[str], radius: float, length: int, aggregate: str, kind: str, dimensions: int):
        self.number = {s: k for k, s in enumerate(streams)}
        self.radius, self.length, self.kind, self.aggregate = radius, length, kind, self.number.get(aggregate, -1)
        self.stream, self.x, self.v = np.zeros(0, np.int64), np.zeros((0, dimensions)), np.zeros(0)

    def restore(self, streams: list, points: list, values: list) -> None:
        self.stream = np.array([self.number.get(s, -1) for s in streams], np.int64)
        self.x, self.v = np.array(points, float).reshape(len(streams), -1), np.array(values, float)

    def _near(self, point: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        x = self.x[at]
        if self.kind == "euclidean":
            gap = x - point
            return np.sqrt((gap * gap).sum(axis=1)) <= self.radius
        norms = np.sqrt((x * x).sum(axis=1)) * np.sqrt((point * point).sum())
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(norms == 0, 1.0, 1 - np.maximum(0.0, x @ point / norms)) <= self.radius

    def combinations(self, stream: int, point: np.ndarray, value: float) -> tuple[int, float]:
        """How many combinations a row makes with the window's rows, and the sum of the aggregated stream's values."""
        if stream < 0:
            return 0, 0.0
        near = self._near(point, slice(None))
        sides = [np.flatnonzero(near & (self.stream == k)) for k in range(len(self.number)) if k != stream]
        if not all(map(len, sides)):
            return 0, 0.0
        found = [(i,) for i in sides[0].tolist()]
        for side in sides[1:]:
            ok = {i: set(side[self._near(self.x[i], side)].tolist()) for c in found for i in c}
            found = [(*c, j) for c in found for j in sorted(set.intersection(*(ok[i] for i in c)))]
        if stream == self.aggregate:
            return len(found), len(found) * value
        return len(found), float(sum(self.v[i] for c in found for i in c if self.stream[i] == self.aggregate))

    def push(self, stream: int, point: np.ndarray, value: float) -> tuple[tuple[int, float], tuple[int, float]]:
        """What a new row adds, and what the row that it pushes out takes away."""
        gone = (0, 0.0)
        if len(self.v) >= self.length:
            old = int(self.stream[0]), self.x[0], float(self.v[0])
            self.stream, self.x, self.v = self.stream[1:], self.x[1:], self.v[1:]
            gone = self.combinations(*old)
        made = self.combinations(stream, point, value)
        self.stream, self.x, self.v = np.append(self.stream, stream), np.vstack([self.x, point]), np.append(self.v, value)
        return made, gone


def count_window(
    df: DataFrame, key: str, order: str, stream: str, on: Sequence[str], value: str, streams: Sequence[str], radius: float, length: int, aggregate: str,
    kind: str = "euclidean",
) -> DataFrame:
    """After each row: combinations added and expired by it, and the window's count, sum and avg of ``aggregate``'s value.

    Rows of other streams, and rows with a null on an axis, take their place in the window and join nothing.
    """
    streams, on = list(streams), sorted(on)
    if kind not in ("euclidean", "cosine"):
        raise ValueError(f"no count window by {kind}")

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, count, total = 0, 0, 0.0
        window = Window(streams, radius, length, aggregate, kind, len(on))
        if state.exists:
            seq, names, points, values, count, total = state.get
            window.restore(names, points, values)
        out = []
        rows = pd.concat(list(batches)).sort_values(order)
        x = rows[on].to_numpy(dtype=float)
        numbers = np.where(np.isnan(x).any(axis=1), -1, rows[stream].map(window.number).fillna(-1).to_numpy()).astype(int)
        for s, p, v in zip(numbers.tolist(), x, rows[value].astype(float).fillna(0.0).tolist(), strict=True):
            seq += 1
            (made, plus), (gone, minus) = window.push(s, p, v)
            count, total = count + made - gone, total + plus - minus
            out.append((str(group[0]), seq, made, gone, count, total, total / count if count else 0.0))
        state.update((seq, ["" if s < 0 else streams[s] for s in window.stream.tolist()], np.nan_to_num(window.x).tolist(), window.v.tolist(), count, total))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return df.groupBy(key).applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
