"""The pipeline's near-dedup against brute force by exact Jaccard similarity of five-word shingles."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from proxjoin.llm import shingles, simhash


def rows():
    rnd = random.Random(11)
    out: list[str | None] = [None, "", " \n", "one two", "One  two", "one two three"]
    for _ in range(12):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([30, 120, 400]))]
        for _ in range(8):  # chains of copies with some changed words: similarities on both sides of 0.8
            out.append(" ".join(words))
            words = list(words)
            for _ in range(max(1, len(words) // rnd.choice([30, 50, 90]))):
                words[rnd.randrange(len(words))] = f"v{rnd.randrange(5000)}"
    return [(i, t) for i, t in enumerate(out)] + [(None, out[8]), (7, out[7])]


def grouped(data):
    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [cut(t) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(data):
        groups[find(i)].append(r[0])
    return sorted(sorted(map(str, g)) for g in groups.values())


@pytest.mark.parametrize("leaders", [1, 32])
def test_near_duplicates_are_brute_force(spark, leaders):
    data = rows()
    got = defaultdict(list)
    for r in shingles.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(3), leaders=leaders).collect():
        got[r.root].append(str(r.doc_id))
    assert sorted(map(sorted, got.values())) == grouped(data)


def test_stage_keeps_one_of_each_group(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string")
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()
    want = grouped(data)
    assert sorted(str(r.doc_id) for r in kept) == sorted(min((x for x in g if x != "None"), key=int) for g in want)
    assert corpus_pipeline.simhash_near_dedup(spark, docs.limit(0), "").count() == 0


def test_bit_sliced_counters_count():
    import numpy as np

    rnd = np.random.default_rng(2)
    bits = rnd.random((128, 1000)) < rnd.random(1000)
    planes = np.packbits(bits, axis=1, bitorder="little")
    for radius in (0, 1, 31, 52, 63, 64, 127, 128, 500):
        got = np.unpackbits(simhash.within(iter(planes), radius), count=1000, bitorder="little").astype(bool)
        assert (got == (bits.sum(axis=0) <= radius)).all()
    far = [np.full(4, 255, np.uint8)] * 128
    seen = iter(far)
    assert not simhash.within(seen, 20).any() and len(list(seen)) == 128 - 32  # left after the second block


def test_fingerprints_of_near_sets_are_near():
    rnd = random.Random(1)
    for size in (5, 9, 10, 40, 400):
        for _ in range(200):
            a = rnd.sample(range(1 << 62), size)
            b = a[: len(a) - max(1, size // 9)] + (rnd.sample(range(1 << 62), size // 10) if size > 9 else [])
            if 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b)):
                x, y = (int.from_bytes(shingles.simhash_128(shingles.np.array(sorted(s), "<u8")), "little") for s in (a, b))
                assert (x ^ y).bit_count() <= shingles.RADIUS


def test_families_in_blocks_are_brute_force(spark):
    """Families of several blocks, one component much the largest, beside families of one."""
    data = rows()
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    for k in range(60):  # most are close to the first, every fourth is between 0.6 and 0.9 from all
        words = list(base)
        for _ in range(10 if k % 4 == 0 else 2):
            words[rnd.randrange(len(words))] = f"u{rnd.randrange(9000)}"
        data.append((1000 + k, " ".join(words)))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for block in (1, 20_000):
        got = defaultdict(list)
        for r in shingles.near_duplicates(docs, block=block).collect():
            got[r.root].append(str(r.doc_id))
        assert sorted(map(sorted, got.values())) == grouped(data)


def test_links_of_two_blocks_connect_what_is_similar_across():
    import numpy as np

    rnd = random.Random(3)
    for _ in range(30):
        base = rnd.sample(range(1 << 62), rnd.choice([1, 2, 5, 40]))
        sets = [np.unique(np.array([x if rnd.random() > rnd.choice([0.02, 0.1, 0.3]) else rnd.randrange(1 << 62) for x in base], "<u8")) for _ in range(12)]
        own, roots = [rnd.randrange(2) for _ in sets], [rnd.choice([k, 100]) for k in range(12)]
        found = shingles._links(list(range(12)), own, roots, [shingles.simhash_128(s) for s in sets], [s.tobytes() for s in sets])

        def classes(pairs):
            root = {k: k for k in range(12)}
            for a, b in pairs:
                root = {k: root[a] if r == root[b] else r for k, r in root.items()}
            return {tuple(root[k] == root[m] for m in range(12)) for k in range(12)}

        given = [(a, b) for a in range(12) for b in range(a) if roots[a] == roots[b]]
        across = len(set(own)) > 1
        want = [(a, b) for a in range(12) for b in range(a) if (own[a] != own[b] or not across) and 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b]))]
        assert classes(given + found) == classes(given + want)
        assert all(roots[a] != roots[b] for a, b in found)


def test_members_of_families_are_told_once(spark, monkeypatch):
    """A set meets many hubs of its group; what goes on is a row for each set, not two for each set and hub."""
    rnd, written, plain = random.Random(5), {}, shingles.materialize

    def told(df, *args, **more):
        out = plain(df, *args, **more)
        written[tuple(out.columns)] = out
        return out

    monkeypatch.setattr(shingles, "materialize", told)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    data = []
    for k in range(60):
        words = list(base)
        for _ in range(10 if k % 4 == 0 else 2):
            words[rnd.randrange(len(words))] = f"u{rnd.randrange(9000)}"
        data.append((k, " ".join(words)))
    assert shingles.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).count() == 60
    members = [t for names, t in written.items() if {"id", "root"} <= set(names) and "a" not in names]
    assert len(members) == 2 and all(40 < t.count() <= 60 for t in members)
