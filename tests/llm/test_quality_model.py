"""The label model: SQL gives the same verdicts, every family counts, labels agree."""

import duckdb
import numpy as np
import pytest

from proxjoin.llm import queries, quality
from proxjoin.llm.common import materialize

ODD = [None, "", " \n\t", "one", "a b c a b c a b c\na b c\n\na b c", "MAIN!! " * 70, "x | y " * 60, "#a $b " * 60, "12 3,4 5x " * 60, "Und das ist der Tag. " * 3 + "Ähnlich wie die Übung. " * 20, "日本 語 " * 40, "\\ { } [ ] ' \" " * 30, "end\r\nof line.\x0b \n" * 30]


def sql(folder=None, rows=None):
    con = duckdb.connect()
    if folder:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    else:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return con.execute(quality.oracle_sql()).fetchall()


def order(rows):
    return sorted(repr(tuple(r)) for r in rows)


def test_query_is_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert order(queries.op7_quality_rules(spark, folder).collect()) == order(sql(folder))


def test_odd_texts_are_their_sql(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "one"), (None, None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, n_words string, _vote_length string")
    judged = quality.judge(materialize(quality.features(docs.drop("_vote_length"))))
    got = judged.select("doc_id", *quality.BASE, "base_failed", "kept", "quality").collect()
    want = sql(rows=rows)
    assert order(r[:-1] for r in got) == order(r[:-1] for r in want)
    assert sorted(round(r[-1], 6) for r in got) == pytest.approx(sorted(r[-1] for r in want), abs=2e-6)
    assert quality.keep_good(docs).columns == docs.columns


@pytest.fixture(scope="module")
def judged(spark):
    folder = "/root/testdata/sf0.01"
    featured = materialize(quality.features(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")))
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "quality AS label")
    out = quality.judge(featured).join(labels, "doc_id", "left").withColumns(quality.rules() | {f"family_{n}": v for n, v in quality.votes().items()})
    return out.select("kept", "base_failed", "quality", "label", *quality.RULES, *[f"family_{n}" for n in quality.FAMILIES]).collect()


def test_rules_vote_both_ways_and_none_is_the_verdict(judged):
    for name in quality.RULES:
        cast = {r[name] for r in judged}
        assert 1 in cast and (-1 in cast or name in ("numbers", "word_length", "line_ends")), name  # three faults that these rows lack
        assert any(r.kept != (r[name] > 0) for r in judged), name
    assert any(r["quality"] < 0.5 for r in judged) and len({r["quality"] for r in judged}) > 10


def test_labels_agree(judged):
    bad = [r for r in judged if r.label == 0]
    good = [r for r in judged if r.label == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) / len(bad) > 0.95
    assert sum(r.kept for r in good) / len(good) > 0.97


def test_fit_moves_and_stays_within_bounds(judged):
    patterns: dict = {}
    for r in judged:
        v = tuple(r[f"family_{n}"] for n in quality.FAMILIES)
        patterns[v] = patterns.get(v, 0) + 1
    begin = quality.starts(len(quality.FAMILIES))
    share, rates = quality.estimate(patterns.items(), begin)
    assert 0.5 < share[0] < 0.99 and share.sum() == pytest.approx(1)
    assert ((rates > 0) & (rates < 1)).all() and (np.abs(rates - begin) > 1e-4).mean() > 0.9
    held = {v: c for v, c in patterns.items() if v[4] >= 0}
    other, _ = quality.estimate(held.items(), begin)
    assert other[0] > share[0]  # fewer faults, more good documents
