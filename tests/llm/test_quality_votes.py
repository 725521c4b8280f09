"""The posterior against verdicts that a rule gives together with the base rules, where votes conflict."""

from proxjoin.llm import quality
from proxjoin.llm.common import materialize

FOLDER = "/root/testdata/sf0.001"


def test_columns_of_the_verdict(spark):
    """What is kept passes the base rules, and the posterior decides about what passes them."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    judged = quality.judge(materialize(quality.features(docs))).collect()
    assert all(not r.base_failed for r in judged if r.kept)
    passing = [r for r in judged if not r.base_failed]
    assert all(r.kept == (r.quality >= 0.5) for r in passing) and any(not r.kept for r in passing)
