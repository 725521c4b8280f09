"""Pairs by blocks: a row is shipped for a bounded number of blocks, which are compared in parts."""

import numpy as np
import pandas as pd
import pytest

from proxjoin.operators import join


def test_rows_are_shipped_for_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(join, "AT_ONCE", 8)
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(300, 3))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
    pairs = join.array_pairs(frame, "v", 0.05)
    assert "pmod(xxhash64(id" in (plan := pairs._jdf.queryExecution().optimizedPlan().toString()) and "), 16)" in plan
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    near = 1 - unit @ unit.T <= 0.05
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if near[i, j]}
    assert want and {(r.id_a, r.id_b) for r in pairs.collect()} == want


@pytest.mark.parametrize("kind", ["cosine", "euclidean"])
def test_parts_of_blocks_give_the_same(kind):
    rnd = np.random.default_rng(4)
    group = pd.DataFrame({"id": range(90), "v": list(rnd.normal(size=(90, 2))), "own": [k % 2 for k in range(90)]})
    for key in ((0, 1), (0, 0)):
        part = group if key == (0, 1) else group[group["own"] == 0]
        whole, parts = (join.tile(kind, 0.3, n)(key, part).sort_values(["id_a", "id_b"]).reset_index(drop=True) for n in (1000, 7))
        assert len(whole) > 20 and whole[["id_a", "id_b"]].equals(parts[["id_a", "id_b"]]) and np.allclose(whole["distance"], parts["distance"])
