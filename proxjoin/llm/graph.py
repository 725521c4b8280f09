"""Connected components of an edge table, by hooking nodes to their least neighbours and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxjoin.llm.common import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def _to_the_end(hooks: DataFrame) -> DataFrame:
    """Hooks (node, root) followed until none leads to a node that is hooked elsewhere; each pass halves the way."""
    while True:
        on = hooks.where("root <> node").select(F.col("node").alias("root"), F.col("root").alias("far"))
        if not hooks.join(on, "root", "left_semi").limit(1).count():
            return hooks
        hooks = materialize(hooks.join(on, "root", "left").select("node", F.coalesce("far", "root").alias("root")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches. Nodes without edges aren't returned.

    Each round hooks every node to its least neighbour, if that is less, follows the hooks to their ends, and puts the ends in
    the nodes' place. Edges within one node go, so a star, however large, takes part in one round, and only what is left
    between stars in the next. Every round is written, so a lost executor costs one round.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while True:
        hooks = materialize(_both(edges).groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
        rounds.append(_to_the_end(hooks))
        end = lambda c, name: rounds[-1].select(F.col("node").alias(c), F.col("root").alias(name))
        left = edges.join(end("a", "p"), "a").select("p", "b").join(end("b", "q"), "b").where("p <> q")
        edges = materialize(left.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
        if not edges.limit(1).count():
            break
    out = rounds.pop()
    while rounds:
        last = out.select(F.col("node").alias("root"), F.col("root").alias("far"))
        out = rounds.pop().join(last, "root", "left").select("node", F.coalesce("far", "root").alias("root"))
    return out
