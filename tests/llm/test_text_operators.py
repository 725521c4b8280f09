"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from proxjoin.llm import importance, licenses, mixing, packing, passages, quality, sharding, simhash, suffixes
from proxjoin.llm.common import materialize
from proxjoin.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, source string, row string, n_words string, _key string, taken long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts() -> list[str | None]:
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "##", "a&b", "日本"]
    some = [" ".join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 3, 40, 90, 200]))) for _ in range(24)]
    shared = " ".join(rnd.choices(vocabulary, k=120))
    long = "\n".join(" ".join(rnd.choices(vocabulary, k=50)) for _ in range(100))
    near = long.split(" ")
    near[700] = "changed"
    return [None, "", " \n\t", "one", "One", *some, some[0], some[0], f"{some[1]} {shared} x", f"{shared} {some[2]}", long, " ".join(near), "line one two three\nline one two three\n\nother", "%%% *** ### " * 40]


@pytest.fixture(scope="module")
def rows():
    sources = ["b", "a", None, "c"]
    out = [(i, t, "hot" if i % 3 == 0 else sources[i % 4], "x", "y", "z", 1) for i, t in enumerate(texts())]
    return [*out, out[7], (None, "no id at all", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(frame, want) -> None:
    order = lambda rows: sorted(map(repr, rows))
    assert order(tuple(r) for r in frame.collect()) == order(want)


def test_quality_base(docs, rows):
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(covered)))
    same(quality.features(docs).select("doc_id", *quality.BASE), want)


def test_quality_verdict(docs, rows, empty):
    featured = materialize(quality.features(docs.select("doc_id", "text")))
    judged = quality.judge(featured).collect()
    assert len(judged) == len(rows)
    assert not any(r.kept for r in judged if r.n_words < 50)
    assert any(r.kept for r in judged)
    assert not any(r.kept for r in judged if r.n_symbols > r.n_words)
    assert all(0 <= r.quality <= 1 for r in judged)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(empty).count() == 0


def test_quality_fit_finds_accuracies():
    rnd = random.Random(1)
    counts = Counter()
    true = [0.9, 0.7, 0.9, 0.65, 0.8, 0.75]
    for _ in range(20_000):
        y = 1 if rnd.random() < 0.7 else -1
        counts[tuple(0 if rnd.random() < 0.2 else (y if rnd.random() < a else -y) for a in true)] += 1
    prior, logits = quality.fit(sorted(counts.items()))
    assert abs(1 / (1 + math.exp(-prior)) - 0.7) < 0.03
    assert all(abs(1 / (1 + math.exp(-x)) - a) < 0.04 for x, a in zip(logits, true, strict=True))


def fingerprint(t: str) -> int:
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, empty):
    prints = [fingerprint(t or "") for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    want = [(r[0], struct.unpack("<q", struct.pack("<Q", prints[i]))[0], min((x for x in least[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)]
    same(simhash.near_duplicates(docs).select("doc_id", "fp", "component_id"), want)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("size", [3, 47, 48, 49, 130, 700])
def test_simhash_buckets(size):
    rnd = np.random.default_rng(size)
    low = np.unique(rnd.integers(0, 1 << 16, size, dtype=np.uint64))
    fps = np.sort(low)
    table = np.zeros(len(fps), np.int64)
    table[:] = [i for i, m in enumerate(simhash.MASKS) if m & 0xFFFF == 0][0]
    a, b = simhash.bucket_links(fps, table)
    parent = {int(x): int(x) for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent[find(x)] = find(y)
    near = {(int(x), int(y)) for x in fps for y in fps if x < y and (int(x) ^ int(y)).bit_count() <= 2}
    full = {int(x): int(x) for x in fps}

    def root(x):
        while full[x] != x:
            x = full[x]
        return x

    for x, y in near:
        full[root(x)] = root(y)
    assert all((find(int(x)) == find(int(y))) == (root(int(x)) == root(int(y))) for x in fps for y in fps)


@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=6), st.integers(8, 12), st.sampled_from([64, 1 << 20]))
@settings(max_examples=60, deadline=None)
def test_suffixes(strings, length, budget):
    t = np.array([c for s in strings for c in (*(x + 1 for x in s), 0)], np.int16)
    ends = [i for i, x in enumerate(t) if x == 0]

    def suffix(i):
        end = next(e for e in ends if e >= i)
        return bytes(int(x) for x in t[i:end]), end

    assert suffixes.suffix_array(t, budget).tolist() == sorted(range(len(t)), key=suffix)
    seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    want = [[seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]
    assert [x.tolist() for x in suffixes.repeated_starts(strings, length, budget)] == want


def removed(rows) -> dict:
    seen = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("split", [20_000, 1])
def test_passages(docs, rows, empty, split, monkeypatch):
    whole = passages.repeated_passages
    monkeypatch.setattr(passages, "repeated_passages", lambda *a, **k: whole(*a, **k, split=split, shard_bytes=2000))
    same(passages.digest(docs), removed(rows))
    if split > 1:
        cut = passages.remove_passages(docs, size=None)
        assert cut.columns == docs.columns and cut.count() == len(rows)
        assert passages.digest(empty).count() == 0 and passages.remove_passages(empty, size=None).count() == 0


def water(sizes: dict, weights=(5, 2, 1)) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in held)
        left = sum(weight[s] for s in order if s not in held)
        target = {s: 3.0 * sizes[s] if s in held else weight[s] * rest / left for s in order}
        if not (over := {s for s in order if s not in held and target[s] > 3 * sizes[s]}):
            return target
        held |= over


@pytest.mark.parametrize("block", [7, 1024])
def test_mixing(docs, rows, empty, block):
    got = mixing.mix(docs, block=block, keep=["source"]).collect()
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target = water(sizes)
    same_rows = sorted((repr(i), len(WORD.findall(t or "")), sizes[s]) for i, t, s, *_ in rows)
    assert sorted((repr(r.doc_id), r["size"], r.source_size) for r in got) == same_rows
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source], rel=1e-12)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(taken[s] == round(target[s]) for s in sizes)
    assert sorted(map(repr, mixing.mix(docs.repartition(5), block=block, keep=["source"]).collect())) == sorted(map(repr, got))
    mixed = mixing.mixed(docs, block=block)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text))
    assert all(words[s] == taken[s] for s in sizes)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    pieces = packing.pack(docs, tokenizer_path(), window=100).collect()
    stream = {}
    for p in pieces:
        for k in range(p.length):
            at = (p.sequence_id, p.offset + k)
            assert at not in stream
            stream[at] = p
    assert sorted(stream) == [divmod(i, 100) for i in range(len(stream))]
    ids = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, *_ in rows]
    want = Counter((i, len(x)) for i, x in ids)
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == want
    by = dict(ids)
    for p in pieces:
        if p.doc_id is not None:
            assert p.ids_crc32 == zlib.crc32(np.array(by[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
    assert packing.pack(empty, tokenizer_path()).count() == 0


@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
@settings(max_examples=300, deadline=None)
def test_fast_ids_are_the_tokenizers_ids(text):
    e = packing.encoder(tokenizer_path())
    assert e.fast is not None
    assert e.ids(text).tolist() == e.plain.encode(text, add_special_tokens=False).ids


def test_ids_of_other_scripts_and_special_names():
    e = packing.encoder(tokenizer_path())
    for text in ("日本語 テキスト", "a b ​", "<|endoftext|>", "😀 emoji", "x" * 500):
        assert e.ids(text).tolist() == e.plain.encode(text, add_special_tokens=False).ids


def test_sharding(docs, rows, empty):
    got = sharding.assign(docs, shards=7).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(raw(t)) + 16, zlib.crc32(raw(t))) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by.get(s, [])) for s in range(7)]
    assert max(counts) - min(counts) <= 1 and {r.law for r in got} == {"rows"}
    assert sharding.assign(empty).count() == 0


def test_sharding_brings_copies_together(spark):
    rows = [(i, f"text {i % 100}" if i % 10 else "hot") for i in range(1000)]
    got = {r.doc_id: r.shard for r in sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=5).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(got[i])
    together = sum(max(Counter(v).values()) for v in groups.values())
    assert together >= 900
    assert sorted(Counter(got.values()).values()) == [200] * 5


def test_licenses(spark, empty):
    a = licenses.SENTENCES
    rows = [
        (1, "Released under the MIT License.", "MIT", "permissive"), (2, "MIT. Nothing else", "", ""), (3, None, "", ""), (4, "", "", ""),
        (5, "x\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,GPL-3.0", "copyleft,noncommercial"),
        (6, ". ".join(a[k] for k in ("B1", "B2", "B3")) + ".", "BSD-2-Clause", "permissive"), (7, ". ".join(a[k] for k in ("B1", "B3", "B2")), "", ""), (1, "Released under the MIT License.", "MIT", "permissive"),
    ]
    made = spark.createDataFrame([(i, t, "z", "q") for i, t, *_ in rows], "doc_id long, text string, seq string, licenses string")
    same(licenses.scan(made).select("doc_id", "licenses", "kinds"), [(i, x, k) for i, _, x, k in rows])
    assert licenses.scan(empty).count() == 0


def test_importance(spark, docs, rows, empty):
    rnd = random.Random(3)
    good = [" ".join(rnd.choices([f"g{i}" for i in range(50)], k=60)) for _ in range(200)]
    bad = [" ".join(rnd.choices([f"b{i}" for i in range(50)], k=60)) for _ in range(100)]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 300, 3)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = importance.classify(made, labels).collect()
    assert sum(r.kept for r in got) == 201 or sum(r.kept for r in got) == 200
    held_out = [(r.doc_id < 200) == r.kept for r in got if r.doc_id % 3]
    assert sum(held_out) / len(held_out) > 0.98
    none = labels.limit(0)
    assert all(r.kept and r.log_weight == 0 for r in importance.classify(docs, none).collect())
    assert importance.classify(empty, labels).count() == 0


@pytest.mark.parametrize("text", [None, "", "One two", "a\tB  a"])
def test_ngrams_follow_words(text):
    w = WORD.findall((text or "").lower())
    assert len(importance.ngrams(text)) == max(0, 2 * len(w) - 1)
    assert importance.ngrams("a b a")[0] == importance.ngrams("A")[0]
