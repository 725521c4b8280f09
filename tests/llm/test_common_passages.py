"""A passage that very many documents share with different surroundings: no shard grows with it, and all of it goes."""

import random

import numpy as np
import pytest

from proxjoin.llm import passages
from proxjoin.llm.suffixes import repeated_starts


@pytest.mark.parametrize("size", [205, 300])
def test_no_shard_grows_with_a_common_passage(spark, size, monkeypatch, tmp_path):
    rnd = random.Random(size)
    letters = "abcdefghijklmnopqrstuvwxyz "
    free = lambda n: "".join(rnd.choices(letters, k=n))
    shared, rows = free(size), []
    for i in range(120):
        rows.append((i, free(220) + shared + free(220), size))
    folder = str(tmp_path)

    def noted(strings, length, *more):
        with open(f"{folder}/{rnd.random()}-{id(strings)}", "w") as f:
            f.write(str(len(strings)))
        return repeated_starts(strings, length, *more)

    whole = passages.repeated_passages
    monkeypatch.setattr(passages, "repeated_starts", noted)
    monkeypatch.setattr(passages, "repeated_passages", lambda *a, **k: whole(*a, **k, split=20, shard_bytes=1))
    got = passages.digest(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)).collect()
    # An edge byte may agree by chance with another document's, and then goes too.
    assert len(got) == 120 and all(size <= r.n_removed <= size + 8 and r.n_spans == 1 for r in got)
    assert (shards := [int(f.read_text()) for f in tmp_path.iterdir()]) and np.max(shards) <= 20
