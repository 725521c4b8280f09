"""The pipeline's near-dedup meets sets by the strongest bits of their SimHashes, and compares SimHashes in each bucket."""

import random

import numpy as np

from proxjoin.llm import shingles


def drawn(rnd, n):
    return [rnd.randrange(1 << 64) for _ in range(n)]


def test_votes_are_counted_one_by_one():
    rnd = random.Random(1)
    mask = (1 << 64) - 1
    for n in (1, 7, 300):
        some = drawn(rnd, n)
        got, bits = shingles.votes(np.array(some, "<u8")), shingles.strongest(np.array(some, "<u8"))
        for group in [rnd.randrange(256) for _ in range(6)]:
            r, g = divmod(group, shingles.SHARING)
            want = []
            for w in range(shingles.WIDTH):
                total = 0
                for s in some:
                    m = (s * int(shingles._FACTORS[r, 0]) + int(shingles._TERMS[r, 0])) & mask
                    m ^= m >> 29
                    m = m * 0xBF58476D1CE4E5B9 & mask
                    m ^= m >> 32
                    odd = (m & w & 255).bit_count() + (m >> 20 & g & 31).bit_count() + (m >> 25 & 1)
                    total += -1 if odd & 1 else 1
                want.append(total)
            assert got[:, group].tolist() == want
            best = max(range(shingles.WIDTH), key=lambda w: (abs(want[w]), w))
            assert bits[group] == 2 * best + (want[best] < 0)


def test_similar_sets_meet_and_others_do_not():
    """Similarity 0.8 and no more: 13 tables on average, never none here; different sets meet in none."""
    rnd = random.Random(2)
    met = []
    for k in range(200):
        n = rnd.choice([18, 45, 180])
        some = drawn(rnd, n + n // 9)
        sets = [np.array(sorted(x), "<u8") for x in (some[:n], some[n // 9 :])]
        a, b = (shingles.table_keys(shingles.strongest(x)[None])[0] for x in sets)
        assert len(set(a.tolist())) == len(shingles.TABLES) == 255 and a.max() < 1 << 35
        met.append((a == b).sum())
        other = shingles.table_keys(shingles.strongest(np.array(drawn(rnd, n), "<u8"))[None])[0]
        assert not (a == other).any()
    assert min(met) > 0 and 10 < np.mean(met) < 17


def test_hubs_are_near_by_simhash():
    rnd = random.Random(3)
    base = [bytes(rnd.randrange(256) for _ in range(16)) for _ in range(3)]

    def flipped(x, n):
        value = int.from_bytes(x, "little")
        for b in rnd.sample(range(128), n):
            value ^= 1 << b
        return value.to_bytes(16, "little")

    rows = [(1, 7, base[0]), (2, 7, flipped(base[0], 20)), (3, 7, bytes(255 - c for c in base[0])), (1, 9, base[1]), (5, 11, base[2]), (6, 11, base[2])]
    rows += [(10 + k, 12, bytes(rnd.randrange(256) for _ in range(16))) for k in range(shingles.MET + 5)]  # a large bucket goes on whole
    ids, keys, prints = (np.array(c) for c in zip(*[(i, k, 0) for i, k, _ in rows], strict=True))
    hubs, linked = shingles.bucket_hubs(ids, keys, shingles._prints_of([p for _, _, p in rows]))
    got = set(zip(hubs.tolist(), linked.tolist(), strict=True))
    assert got == {(1, 2), (5, 6)} | {(10, 10 + k) for k in range(1, shingles.MET + 5)}


def test_buckets_go_on_in_the_next_batch(spark):
    """Shared entries and hubs don't depend on where batches end."""
    rnd = random.Random(4)
    sizes = [rnd.choice([1, 1, 2, 3, 40]) for _ in range(60)] + [3 * shingles.MET]
    rows = [(i, key) for key, size in enumerate(sizes) for i in range(key, key + size)]
    entries = spark.createDataFrame(rows, "id long, key long")
    wanted = spark.createDataFrame([(i, bytearray(16)) for i in {i for i, _ in rows}], "id long, fp binary")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (1, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            shared = shingles._shared(entries)
            assert sorted(map(tuple, shared.collect())) == sorted(r for r in rows if sizes[r[1]] > 1)
            hubs = shingles._hubs(shared, wanted).collect()
            assert {(r.a, r.id) for r in hubs} == {(key, i) for i, key in rows if i > key} and len(hubs) == len({(r.a, r.id) for r in hubs})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
