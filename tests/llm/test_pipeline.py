"""The pipeline's stages, each against its own input."""

import random
from collections import Counter

import corpus_pipeline

from proxjoin.llm import mixing, packing, passages, quality
from proxjoin.llm.common import materialize
from proxjoin.llm.queries import tokenizer_path

from test_shingles import grouped

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, states = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, states[-1], FOLDER)
        out.write.parquet(str(tmp_path / str(k)))
        states.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == 4 or states[-1].columns == columns
    start, good, single, cut, mixed, packed = states
    judged = quality.judge(materialize(quality.features(start)))
    assert Counter(r.doc_id for r in judged.where("kept").collect()) == Counter(r.doc_id for r in good.collect())
    assert 0 < good.count() < start.count()
    # Brute force by five words and similarity 0.8: the job's rule for stages on word shingles.
    groups = {min(map(int, g)) for g in grouped([(r.doc_id, r.text) for r in good.collect()])}
    assert {r.doc_id for r in single.collect()} == groups and single.count() == len(groups)
    sizes = {r.doc_id: (r.n_bytes, r.n_removed) for r in passages.digest(single).collect()}
    for r in cut.collect():
        n, gone = sizes[r.doc_id]
        assert n - gone - 6 <= len(r.text.encode()) <= n - gone and r.n_chars == len(r.text)
    plan = {r.doc_id: r.taken for r in mixing.mix(cut).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({k: v for k, v in plan.items() if v})
    tokens = sum(r.length for r in packed.collect())
    assert tokens == sum(r.n for r in packing.tokenize(mixed, tokenizer_path()).select("n").collect())


def test_names_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "mixing sources", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_over_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, copies, clashing names, and no rows at all go through all stages."""
    rnd = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ka", "mo", "ri", "su") for b in ("lan", "ver", "tor", "min", "pel") for c in ("", "ed", "ing", "ly", "er")]
    prose = lambda n: " ".join(" ".join(rnd.choices(["the", "of", "and", "to", "is", *rnd.sample(words, 8)], k=9)).capitalize() + "." for _ in range(n))
    rows = [(i, prose(20), "en", f"s{i % 3}" if i % 4 else None, 7) for i in range(40)]
    rows += [(rows[3][0], rows[3][1], "en", "s0", 7), (100, rows[5][1], None, None, None), (None, prose(2000), "en", "s1", 7), (101, None, None, None, None), (102, "", "", "", 0), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, _row string, _text string, row long, taken long, n_words long, h long, shingles string"
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2, 3, 4, "z") for r in rows], schema)
    for name, frame in (("full", docs), ("none", docs.limit(0))):
        folder = tmp_path / name
        frame.repartition(3).write.parquet(str(folder / "documents.parquet"))
        packed = corpus_pipeline.run(spark, str(folder)).collect()
        ids = {p.doc_id for p in packed}
        assert (len(packed) > 10 and None in ids and not ids & {101, 102}) if name == "full" else packed == []
        assert sum(p.offset == 0 for p in packed) == len({p.sequence_id for p in packed})
