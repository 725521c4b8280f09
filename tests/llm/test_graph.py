"""Connected components against a union-find, and how many rows their joins make."""

import random

from proxjoin.llm import graph


def reached(edges):
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {v: find(v) for e in edges if e[0] != e[1] for v in e}


def test_components_are_those_of_a_union_find(spark):
    rnd = random.Random(8)
    path = list(range(300, 340))
    shuffled = rnd.sample(range(400, 440), 40)
    edges = [(1, k) for k in range(2, 60)] + [(99, k) for k in range(60, 99)] + [(98, 3)]  # two stars, the greater hub above its leaves
    edges += list(zip(path, path[1:], strict=False)) + list(zip(shuffled, shuffled[1:], strict=False)) + [(500, 500), (-7, 501), (501, -7), (-7, 501)]
    edges += [(rnd.randrange(600, 700), rnd.randrange(600, 700)) for _ in range(80)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == reached(edges)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_star_takes_part_in_one_round(spark, monkeypatch):
    """What is written after the first round doesn't grow with the star: its edges aren't joined again."""
    written = []
    plain = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: written.append((out := plain(df)).count()) or out)
    graph.components(spark.createDataFrame([(0, k) for k in range(1, 501)], "a long, b long")).collect()
    assert written == [500, 501, 0]
