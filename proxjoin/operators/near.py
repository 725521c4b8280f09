"""Pairs of long vectors within a radius, where distances to pivots leave out most pairs of blocks.

Both distances are the length of a difference: cosine distance d of unit vectors is a length of sqrt(2 d). So two vectors
can be within the radius only if their distances to every pivot differ by no more than that length. Rows are grouped by
their nearest pivot and by runs of distance to it; a group keeps its least and greatest distance to each pivot, and
groups whose intervals lie further apart for any pivot never meet. Groups that meet are cut into blocks of bounded rows,
and pairs of blocks are compared by one product each. Groups number rows / block and pivots at most, about; give more
pivots to larger tables, as the groups of two near cells are compared by their intervals one by one.

Defined results: rows whose vector is null, or holds null or non-finite entries, have no pairs; zero vectors are at
cosine distance 1 from all; rows that repeat an id are rows like others, but have no pair with each other. All vectors
must have one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxjoin.operators.join import tile
from proxjoin.sources.scratch import stored

PIVOTS, BLOCK = 128, 1024
#: Relative error that computed distances to pivots may have, and what is added to a cosine radius for its rounding.
SLACK, COSINE_SLACK = 1e-12, 1e-12


class NearPairs:
    """The pairs of a table of vectors within ``radius``; rows with their distances to pivots, and groups, are stored."""

    def __init__(self, df: DataFrame, vector: str, radius: float, id_col: str = "id", kind: str = "cosine", pivots: int = PIVOTS, block: int = BLOCK):
        if kind not in ("cosine", "euclidean"):
            raise ValueError(f"no pivots for distance {kind!r}")
        if kind == "cosine" and radius >= 1:
            raise ValueError("within a cosine distance of 1 everything matches")
        if radius < 0:
            raise ValueError("a radius is 0 or more")
        self.kind, self.radius, self.block = kind, radius, block
        self.reach = float(np.sqrt(2 * (radius + COSINE_SLACK))) if kind == "cosine" else radius * (1 + SLACK)
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
        whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        rows = rows.where(F.col("v").isNotNull() & F.forall("v", whole))
        if kind == "cosine":
            rows = rows.where(F.exists("v", lambda x: x != 0))
        # Pivots change what is left out, never a result; their number is bounded.
        chosen = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()], float)
        self.pivots = len(chosen)
        placed = stored(self._placed(rows, chosen))
        # A row for each pivot. Runs are no narrower than the radius, nor so many that they hold less than a block on average.
        widths = placed.groupBy("cell").agg(F.greatest(F.lit(self.reach), F.max("own") * block / F.count("*")).alias("width"))
        run = F.when(F.col("width") > 0, F.floor(F.col("own") / F.col("width"))).otherwise(F.lit(0)).cast("long")
        self.rows = placed.join(F.broadcast(stored(widths)), "cell").select("id", "v", "far", "cell", run.alias("run"))
        span = [F.array(*[f(F.col("far")[k]) for k in range(max(1, self.pivots))]).alias(n) for n, f in (("low", F.min), ("high", F.max))]
        self.groups = stored(self.rows.groupBy("cell", "run").agg(F.count("*").alias("n"), *span))

    def _placed(self, rows: DataFrame, chosen: np.ndarray) -> DataFrame:
        """(id, v, far, cell, own): distances to all pivots, the nearest pivot, and the distance to it."""
        unit = self.kind == "cosine"

        def lengths(x: np.ndarray) -> np.ndarray:
            if not unit:
                return x
            x = x / np.abs(x).max(axis=1, keepdims=True)
            return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres = lengths(chosen)
            for frame in frames:
                for k in range(0, len(frame), 256):
                    part = frame.iloc[k : k + 256]
                    x = lengths(np.stack(part["v"].to_list()))
                    # Differences, since products cancel far from the origin.
                    far = np.sqrt(((x[:, None, :] - centres[None]) ** 2).sum(axis=2))
                    cell = far.argmin(axis=1)
                    yield part.assign(far=list(far), cell=cell, own=far.min(axis=1))

        return rows.mapInPandas(run, "id long, v array<double>, far array<double>, cell int, own double")

    def _apart(self, a: str, b: str) -> Column:
        """Whether for some pivot the intervals of two groups lie further apart than the radius, rounding included."""
        sides = F.arrays_zip(*[F.col(f"{s}{n}").alias(f"{s}{n}") for s in (a, b) for n in ("low", "high")])
        gap = lambda x: F.greatest(x[f"{a}low"] - x[f"{b}high"], x[f"{b}low"] - x[f"{a}high"])
        return F.exists(sides, lambda x: gap(x) > self.reach + SLACK * (x[f"{a}high"] + x[f"{b}high"]))

    def met(self) -> DataFrame:
        """Pairs of groups that meet: (acell, arun, an, bcell, brun, bn), each once; pairs of cells are tried first."""
        side = lambda df, s: df.select(*[F.col(c).alias(f"{s}{c}") for c in df.columns])
        ends = [F.array(*[f(F.col(n)[k]) for k in range(max(1, self.pivots))]).alias(n) for n, f in (("low", F.min), ("high", F.max))]
        cells = self.groups.groupBy("cell").agg(*ends)
        # At most pivots squared pairs, whatever the table.
        reached = side(cells, "p").join(F.broadcast(side(cells, "q")), (F.col("pcell") <= F.col("qcell")) & ~self._apart("p", "q")).select(F.col("pcell").alias("acell"), F.col("qcell").alias("bcell"))
        pairs = side(self.groups, "a").join(F.broadcast(reached), "acell").join(side(self.groups, "b"), "bcell")
        once = (F.col("acell") < F.col("bcell")) | (F.col("arun") <= F.col("brun"))
        return pairs.where(once & ~self._apart("a", "b")).select("acell", "arun", "an", "bcell", "brun", "bn")

    def share(self) -> DataFrame:
        """One row: all pairs of rows, those that meet in a task, and the share of the pairs that is left out."""
        same = (F.col("acell") == F.col("bcell")) & (F.col("arun") == F.col("brun"))
        meet = self.met().agg(F.coalesce(F.sum(F.when(same, F.expr("an * (an - 1) div 2")).otherwise(F.col("an") * F.col("bn"))), F.lit(0)).alias("pairs_met"))
        every = self.groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(20,0)").alias("n")).select(((F.col("n") * (F.col("n") - 1)) / 2).cast("decimal(38,0)").alias("pairs"))
        return every.crossJoin(meet).withColumn("skipped", F.when(F.col("pairs") > 0, 1 - F.col("pairs_met").cast("double") / F.col("pairs").cast("double")))

    def pairs(self) -> DataFrame:
        """(id_a, id_b, distance) with id_a < id_b."""
        parts = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / self.block) - 1)
        blocks = self.met().withColumn("ap", F.explode(parts("an"))).withColumn("bp", F.explode(parts("bn")))
        same = (F.col("acell") == F.col("bcell")) & (F.col("arun") == F.col("brun"))
        blocks = blocks.where(~same | (F.col("ap") <= F.col("bp")))
        name = lambda s: F.concat_ws(":", f"{s}cell", f"{s}run", f"{s}p")
        blocks = blocks.select(name("a").alias("i"), name("b").alias("j"))
        meets = blocks.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
        counts = self.groups.select("cell", "run", "n")
        part = F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("n") / self.block))
        dealt = self.rows.join(counts, ["cell", "run"]).select("id", "v", F.concat_ws(":", "cell", "run", part).alias("own")).join(meets, "own")
        return dealt.groupBy("i", "j").applyInPandas(tile(self.kind, self.radius), "id_a long, id_b long, distance double")


def near_pairs(df: DataFrame, vector: str, radius: float, id_col: str = "id", kind: str = "cosine", pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b, distance) with id_a < id_b of rows whose vectors lie within the radius."""
    return NearPairs(df, vector, radius, id_col, kind, pivots, block).pairs()
