"""The mix against a walk in plain Python, document by document, and with other points."""

import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from proxjoin.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rnd = random.Random(8)
    out = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 30, 90, 400])), rnd.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(160)]
    return [*out, (500, None, "b"), (501, "", "z"), (None, "one two", "a"), (None, "three", "a"), out[3]]


def order_hash(spark, data):
    made = spark.createDataFrame(data, "doc_id long, text string, source string")
    return [r[0] for r in made.select(F.xxhash64(F.lit(2024), "doc_id", "text")).collect()]


def walked(spark, data, block, point):
    """(doc_id, size, taken, first slot) of each row by walking the points one by one."""
    names = sorted({s for *_, s in data}, key=lambda s: (s is None, s or ""))
    size = [len(WORD.findall(t or "")) for _, t, _ in data]
    total = {n: sum(k for k, (*_, s) in zip(size, data, strict=True) if s == n) for n in names}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    held: set = set()
    while True:
        rest, left = sum(total.values()) - sum(3 * total[n] for n in held), sum(weight[n] for n in names if n not in held)
        target = {n: 3.0 * total[n] if n in held else weight[n] * rest / left for n in names}
        if not (over := {n for n in names if n not in held and target[n] > 3 * total[n]}):
            break
        held |= over
    hashes = order_hash(spark, data)
    line = {n: sorted((i for i, r in enumerate(data) if r[2] == n), key=lambda i: (hashes[i] % 2**64, hashes[i], data[i][0] or -1, size[i])) for n in names}
    words = {n: [i for i in line[n] for _ in range(size[i])] for n in names}
    take = {n: round(target[n]) for n in names}
    blocks = {n: -(-total[n] // block) for n in names}
    slots = {n: take[n] // total[n] * blocks[n] + -(-(take[n] % total[n]) // block) if total[n] else 0 for n in names}
    n_slots, taken, first = sum(slots.values()), defaultdict(int), {}
    low, share = 0, {}
    for n in names:
        share[n] = (low / n_slots, low / n_slots + slots[n] / n_slots)
        low += slots[n]
    rank, slot = dict.fromkeys(names, 0), 0
    while any(rank[n] < slots[n] for n in names) and slot < 10 * n_slots + 100:
        u = point(slot)
        n = next((x for x in names if share[x][0] <= u < share[x][1]), "none")
        if n != "none" and rank[n] < slots[n]:
            at, cut = rank[n] % blocks[n] * block, total[n]
            if rank[n] // blocks[n] == take[n] // total[n]:
                cut = take[n] % total[n]
            for i in words[n][at : min(at + block, cut)]:
                taken[i] += 1
            for i in set(words[n][at : at + block]):
                if i not in first and words[n].index(i) // block == at // block:
                    first[i] = slot
            rank[n] += 1
        slot += 1
    return sorted(repr((r[0], size[i], taken[i], first.get(i) if taken[i] else None)) for i, r in enumerate(data))


def golden(slot):
    i = slot + 1
    return ((i >> 20) * mixing.GOLDEN_20 % 1.0 + (i % (1 << 20)) * mixing.GOLDEN) % 1.0


@pytest.mark.parametrize("block", [7, 256])
def test_every_document_is_taken_as_the_walk_says(spark, block):
    data = rows()
    made = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(made, block=block).collect()
    assert sorted(repr((r.doc_id, r["size"], r.taken, r.first_slot)) for r in got) == walked(spark, data, block, golden)


def test_points_decide(spark, monkeypatch):
    data = rows()
    made = spark.createDataFrame(data, "doc_id long, text string, source string")
    print_of = lambda: sorted(repr((r.doc_id, r["size"], r.taken, r.first_slot)) for r in mixing.mix(made, block=16).collect())
    plain = print_of()
    monkeypatch.setattr(mixing, "_golden", lambda i: F.pmod(i * F.lit(0.7548776662466927), F.lit(1.0)))
    assert print_of() != plain  # other slots
    monkeypatch.setattr(mixing, "_golden", lambda i: i * 0.0 + 0.5)
    # Points that all fall to one source would leave the others without words: an error, not a short mix.
    with pytest.raises(RuntimeError, match="evenly spread"):
        mixing.mix(made, block=16, keep=["source"])


def test_stretches_are_near_the_weights(spark):
    plan = spark.createDataFrame([(False, "a", 5000), (False, "b", 2000), (False, "c", 1000), (True, "", 3)], "no_source boolean, source_key string, slots long")
    slots = sorted((r.slot, r.source_key) for r in mixing.schedule(plan).collect())
    assert len(slots) == 8003
    for k in range(0, 8000, 500):
        here = [s for _, s in slots[k : k + 500]]
        assert abs(here.count("a") - 312) <= 6 and abs(here.count("b") - 125) <= 6 and abs(here.count("c") - 62) <= 6


def test_mix_is_in_order(spark):
    data = rows()
    made = spark.createDataFrame([(*r, 0) for r in data], "doc_id long, text string, source string, n_chars int")
    out = mixing.mixed(made, block=16).collect()
    assert sum(len(WORD.findall(r.text)) for r in out) == sum(r.taken for r in mixing.mix(made, block=16).collect())
    assert all(r.n_chars == len(r.text) for r in out)
    near = [r.source for r in out]
    assert len(set(near[:40])) >= 4  # sources are interleaved from the start
