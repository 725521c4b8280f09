"""Ranked search against scoring every document, and block boundaries against all cuts."""

import math
import random
import re
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from proxjoin.llm import common, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed=1, n=300):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(150)] + ["Ünï", "日本", "A1", "don't", "x_y", "É"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rnd.choice([" ", ", ", "\n", " -"]).join(rnd.choices(words, weights, k=rnd.choice([1, 3, 30, 200])))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(100)]  # ties
    docs += [(900, None), (901, ""), (902, " -- !!"), (None, docs[5][1]), (None, docs[7][1]), (7, docs[7][1]), (903, "w3 " * 30_000 + "rare"), (904, "W3 w3")]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 5, 40])))) for i in range(20)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "w3 w3 W3 rare"), (0, items[0][1]), (1, "w9 w8"), (None, "w5")]
    return docs, items


@pytest.mark.parametrize(("tokens", "chunk", "k", "block"), [(1 << 21, 512, 50, 1024), (500, 7, 3, 2), (3000, 64, 10, 5)])
def test_ranked(spark, monkeypatch, tokens, chunk, k, block):
    for name, value in (("TOKENS", tokens), ("CHUNK", chunk), ("ITEMS", block)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, item_id long").repartition(4)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank(frame, asked, k).collect()]
    assert sorted(got, key=repr) == brute(docs, items, k)


def test_shards_are_read_and_written_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TOKENS", 500)
    docs, items = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    common.clean(spark)
    lexical.rank(frame, spark.createDataFrame(items, "item_id long, text string")).count()
    files = [pq.ParquetFile(p) for t in common._tables for p in Path(t).glob("*.parquet")]
    shards = [f.metadata for f in files if {"shard", "doc_ids"} <= set(f.schema_arrow.names)]
    assert sum(m.num_rows for m in shards) > 50  # of both tables
    assert all(m.num_row_groups == m.num_rows for m in shards)


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank(docs.limit(0), items).count() == 0
    assert lexical.rank(docs, items.limit(0)).count() == 0
    assert lexical.rank(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def cost_of(impact, cut, cost):
    return sum((b - a) * max(impact[a:b]) + cost for a, b in zip([0, *cut[:-1]], cut, strict=True))


@pytest.mark.parametrize("width", [3, 64])
def test_blocks_have_the_least_cost(width):
    rnd = random.Random(4)
    lists = [[rnd.choice([1, 2, 5, 9, 30]) for _ in range(n)] for n in (1, 2, 9, 0, 11, 1, 7)]
    impact, held = np.array([v for some in lists for v in some]), np.array([len(some) for some in lists])
    ends = lexical.best_blocks(impact, held, width, 12)
    start = 0
    for some in lists:
        mine = [int(e) - start for e in ends if start < e <= start + len(some)]
        start += len(some)
        if some:
            cuts = [[*c, len(some)] for r in range(len(some)) for c in combinations(range(1, len(some)), r)]
            cuts = [c for c in cuts if all(b - a <= width for a, b in zip([0, *c[:-1]], c, strict=True))]
            assert mine[-1] == len(some) and cost_of(some, mine, 12) == min(cost_of(some, c, 12) for c in cuts)


def test_blocks_are_skipped_and_sizes_vary():
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, [w.encode() for w in rnd.choices(words, [1 / (n + 1) for n in range(400)], k=rnd.choice([5, 50, 500]))]) for i in range(3000)]
    # A few documents hold rare words many times over.
    docs += [(5000 + i, [b"w300", b"w301"] * 40 + [b"w5"]) for i in range(60)]
    stored = {k: v[0] for k, v in lexical._postings(docs, 0).items()}
    lengths, documents, tokens = stored["lengths"], len(docs), sum(stored["lengths"])
    m = 50 + (50 * np.array(lengths) * documents) // tokens
    tf, at = np.frombuffer(stored["tf"], np.int64), np.frombuffer(stored["docs"], np.int32)
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[at])
    held = np.array(stored["held"])
    ends = lexical.best_blocks(impact, held)
    sizes = np.diff(np.r_[0, ends])
    assert len(set(sizes.tolist())) > 10 and sizes.max() <= lexical.WIDTH
    blocks = np.diff(np.searchsorted(ends, np.cumsum(held), side="right"), prepend=0).astype(np.int32)
    most = np.maximum.reduceat(impact, np.r_[0, ends[:-1]]).astype(np.int32)
    shard = lexical.Shard(stored | {"impact": impact.astype(np.int32).tobytes(), "ends": ends.astype(np.int32).tobytes(), "most": most.tobytes(), "blocks": blocks.tobytes()})
    found, scores = shard.search(["w300", "w301", "w5"], [4000, 4000, 100], 20)
    assert len(found) == 20 and (np.diff(scores) <= 0).all()
    every = sum(int(held[shard.number[t]]) for t in ("w300", "w301", "w5"))
    assert shard.read < 0.5 * every
