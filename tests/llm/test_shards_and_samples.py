"""Cut edges of shards against the least possible; importance weights, keys and the sample against brute force."""

import math
import random
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxjoin.llm import importance, sharding


def cut_edges(placed):
    """Pairs of equal texts in different shards."""
    by = defaultdict(Counter)
    for text, shard in placed:
        by[text][shard] += 1
    return sum(sum(c.values()) * (sum(c.values()) - 1) // 2 - sum(x * (x - 1) // 2 for x in c.values()) for c in by.values())


def least_cut(texts, shards):
    """By trying all ways to spread each text's copies over shards under the quotas."""
    quota = [len(texts) // shards + (s < len(texts) % shards) for s in range(shards)]
    sizes = sorted(Counter(texts).values(), reverse=True)

    def ways(n):
        return [w for w in product(range(n + 1), repeat=shards) if sum(w) == n]

    best = math.inf

    def go(k, left, cut):
        nonlocal best
        if cut >= best:
            return
        if k == len(sizes):
            best = cut
            return
        n = sizes[k]
        for w in sorted(ways(n), key=lambda w: -max(w)):
            if all(a <= b for a, b in zip(w, left, strict=True)):
                go(k + 1, [b - a for a, b in zip(w, left, strict=True)], cut + n * (n - 1) // 2 - sum(x * (x - 1) // 2 for x in w))

    go(0, quota, 0)
    return best


@pytest.mark.parametrize(("sizes", "shards"), [([4, 4, 4] + [1] * 6, 3), ([5, 3, 2] + [1] * 8, 3), ([3, 3, 2, 2] + [1] * 10, 4), ([9] + [1] * 9, 3)])
def test_few_edges_are_cut(spark, sizes, shards):
    texts = [f"t{k}" for k, n in enumerate(sizes) for _ in range(n)]
    rows = list(enumerate(random.Random(5).sample(texts, len(texts))))
    got = {r.doc_id: r.shard for r in sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=shards).collect()}
    cut = cut_edges([(t, got[i]) for i, t in rows])
    home = [r.s for r in spark.createDataFrame(rows, "doc_id long, text string").select(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(shards)).alias("s")).collect()]
    start = cut_edges([(t, h) for (_, t), h in zip(rows, home, strict=True)])
    counts = Counter(got.values())
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    assert least_cut(texts, shards) <= cut <= max(least_cut(texts, shards), start // 2)


def test_groups_that_fit_stay_mostly_whole(spark):
    rnd = random.Random(2)
    texts = [f"t{k}" for k in range(60) for _ in range(rnd.randint(1, 6))]
    rows = list(enumerate(rnd.sample(texts, len(texts))))
    got = {r.doc_id: r.shard for r in sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()}
    assert cut_edges([(t, got[i]) for i, t in rows]) <= 0.1 * cut_edges([(t, i) for i, t in rows])


def sample_rows():
    rnd = random.Random(6)
    texts = [" ".join(rnd.choices([f"{'gb'[i % 2]}{k}" for k in range(30)], k=rnd.choice([1, 5, 40]))) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (3, texts[3]), (None, "g1 g2")]
    labels = [(i, 1 - i % 2, 0) for i in range(0, 40, 3)] + [(2, 0, 0), (4, 1, 1), (None, 1, 0), (999, 1, 0), (6, None, 0), (8, 1, None)]
    return rows, labels


def test_sample_is_brute_force(spark):
    rows, labels = sample_rows()
    made = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, good int, log_weight double").repartition(3)
    got = importance.classify(made, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), buckets=512).collect()
    judged = defaultdict(list)
    for i, q, t in labels:
        if None not in (i, q, t):
            judged[i].append(q > 0 and t == 0)
    good = {i for i, v in judged.items() if all(v)}
    raw, target = np.full(512, 0.5), np.full(512, 0.5)
    for i, t in rows:
        for g in importance.ngrams(t, 512):
            raw[g] += 1
            target[g] += i in good
    w = np.log(target / target.sum()) - np.log(raw / raw.sum())
    hashes = [r[0] for r in spark.createDataFrame(rows, "doc_id long, text string").select(F.xxhash64(F.lit(5), "doc_id")).collect()]
    want = []
    for (i, t), h in zip(rows, hashes, strict=True):
        grams = importance.ngrams(t, 512)
        weight = math.fsum(w[g] for g in grams)
        want.append((i, len(grams), weight, weight - math.log(-math.log((h % (1 << 52) + 0.5) / (1 << 52)))))
    k = round(len(rows) * len(good) / len(judged))
    best = sorted(want, key=lambda r: (-r[3], r[0] is not None, r[0] or 0))[:k]
    line = lambda r: (str(r[0]), r[1], round(r[2], 8), round(r[3], 8))
    assert sorted(line(tuple(r)[:4]) for r in got) == sorted(map(line, want))
    assert Counter(line(tuple(r)[:4]) for r in got if r.kept) == Counter(map(line, best))


def test_equal_keys_go_by_id(spark):
    docs = spark.createDataFrame([(7, "a"), (7, "a"), (7, "a"), (7, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    got = importance.classify(docs, labels).collect()
    assert len({r.gumbel_key for r in got}) == 1 and sum(r.kept for r in got) == 2
