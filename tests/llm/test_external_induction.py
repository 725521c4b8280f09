"""Induction against brute force: shared prefixes carried, queues on disk, names sorted by recursion."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proxjoin.llm import suffixes

SOME = st.lists(st.binary(max_size=60).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=7)


def text(strings):
    return np.array([c for s in strings for c in (*(x + 1 for x in s), 0)], np.int16)


def brute(t, cap):
    ends = np.flatnonzero(t == 0)
    key = lambda i: (t[i : ends[np.searchsorted(ends, i)]].tolist(), int(ends[np.searchsorted(ends, i)]))
    order = sorted(range(len(t)), key=key, reverse=True)
    shared = [0]
    for a, b in zip(order, order[1:], strict=False):
        x, y = key(a)[0], key(b)[0]
        k = 0
        while k < min(len(x), len(y), cap) and x[k] == y[k]:
            k += 1
        shared.append(k)
    return order, shared


@given(SOME, st.sampled_from([1, 3, 8, 200]), st.sampled_from([6, 64, 1 << 20]), st.sampled_from([0, 900, 1 << 20]))
@settings(max_examples=150, deadline=None)
def test_tuples_are_brute_force(strings, cap, budget, memory):
    t = text(strings)
    got = np.concatenate(list(suffixes.descending(t, cap, budget, memory)))
    order, shared = brute(t, cap)
    assert got["place"].tolist() == order
    assert got["shared"].tolist() == shared


@pytest.mark.parametrize("kind", ["random", "periodic", "runs", "copies"])
def test_large_shards_recurse_and_spill(kind, monkeypatch):
    rnd = random.Random(5)
    free = bytes(rnd.choices(b"abcdefghij ", k=6000))
    strings = {"random": [free, free[100:900], bytes(rnd.choices(b"ab", k=3000))], "periodic": [b"abcab" * 900, b"cab" * 500, b"abcab" * 20], "runs": [b"a" * 3000, b"ba" + b"a" * 500, b"b" * 700], "copies": [free[:2000]] * 3 + [free[50:1500]]}[kind]
    deep, spilled = [], suffixes.SpilledQueues.spills
    whole = suffixes._recurse
    monkeypatch.setattr(suffixes, "_recurse", lambda names, *a: deep.append(len(names)) or whole(names, *a))
    got = suffixes.repeated_starts(strings, 40, budget=500, memory=1000)
    assert suffixes.SpilledQueues.spills > spilled
    assert kind == "runs" or deep
    seen = Counter(s[i : i + 40] for s in strings for i in range(len(s) - 39))
    assert [x.tolist() for x in got] == [[seen[s[i : i + 40]] > 1 for i in range(len(s) - 39)] for s in strings]


def test_default_budget_reaches_the_disk():
    rnd = np.random.default_rng(3)
    piece = rnd.integers(97, 123, 1_600_000, dtype=np.uint8).tobytes()
    before = suffixes.SpilledQueues.spills
    got = suffixes.repeated_starts([piece, piece[1000:2000] + b"!" * 300, b"", b"x"], 200)
    assert suffixes.SpilledQueues.spills > before
    assert np.flatnonzero(got[0]).tolist() == list(range(1000, 1801)) and got[1][:801].all() and len(got[2]) == len(got[3]) == 0


def test_passages_spill_in_production():
    from proxjoin.llm import passages

    assert passages.SHARD_BYTES * suffixes.TUPLE.itemsize > 2 * suffixes.BUDGET
