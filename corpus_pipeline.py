"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents. A stage begins by deleting the scratch tables of the one before,
whose result is written by then.

Defined results of every stage: columns pass through as they are, nulls in them included, whatever their names (n_chars
follows the text where that changes); a null text counts as empty and, like all texts of less than 50 words, goes in the
first stage; rows without an id are rows like others; repeated rows are copies, of which one stays after the second
stage; a text of any length is read whole; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from proxjoin.llm import mixing, packing, passages, quality, shingles, simhash
from proxjoin.llm.common import clean, scratch_dir
from proxjoin.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the weighed votes reject go."""
    clean(spark)
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least id: five words, similarity 0.8 or more."""
    clean(spark)
    return simhash.keep_one(docs, near=shingles.near_numbered)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand elsewhere too are cut out of the texts."""
    clean(spark)
    return passages.remove_passages(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: documents go, stay or are repeated, the last of a source's round in part."""
    clean(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    clean(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: XXH64, tokenizers and suffix sorting aren't SQL. Tests hold near-dedup against brute force as a stage, and the other
#: stages against their operators, which have brute-force tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _stored(docs)
    return docs


def _stored(docs: DataFrame) -> DataFrame:
    """A stage's result outlives its scratch tables."""
    path = f"{scratch_dir(docs.sparkSession)}/stage-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)
