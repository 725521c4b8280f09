"""The training-data operators as queries over the whole tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxjoin.llm import annuli, html, importance, lexical, licenses, mixing, neighbours, packing, passages, quality, sharding, simhash, whitening
from proxjoin.llm.common import materialize


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def op2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents").select("doc_id", "text"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text")).drop("at", "start")


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    featured = quality.features(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    return quality.judge(materialize(featured)).select("doc_id", *quality.BASE, "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path())


def op9_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.digest(table(spark, folder, "documents").select("doc_id", "text"))


def op10_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.classify(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text"))


def op13_exact_search(spark: SparkSession, folder: str) -> DataFrame:
    return annuli.top_k(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html, op2_neighbours, op3_sharding, op4_simhash, op5_mixing, op6_licenses, op7_quality_rules, op8_packing, op9_passages, op10_importance, op11_whitening, op12_lexical, op13_exact_search)
}

NEIGHBOURS_SQL = """
WITH usable AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM near)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

EXACT_SQL = """
WITH usable AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LEXICAL_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
full_doc AS (SELECT d, doc_id, terms, len(terms) AS n FROM doc WHERE len(terms) > 0),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM full_doc),
posting AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM full_doc) GROUP BY ALL),
item AS (SELECT row_number() OVER () AS i, item_id, terms FROM (SELECT DISTINCT item_id, text, {_TERMS} AS terms FROM benchmark WHERE text IS NOT NULL)),
wanted AS (SELECT DISTINCT i, item_id, unnest(terms) AS term FROM item),
weight AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM posting CROSS JOIN whole WHERE term IN (SELECT term FROM wanted) GROUP BY term),
impact AS (SELECT d, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // tokens)) AS v FROM posting JOIN full_doc USING (d) CROSS JOIN whole WHERE term IN (SELECT term FROM wanted)),
scored AS (SELECT i, any_value(item_id) AS item_id, d, sum(w * v)::BIGINT AS score FROM wanted JOIN weight USING (term) JOIN impact USING (term) GROUP BY i, d HAVING sum(w * v) > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored JOIN full_doc USING (d))
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""

ORACLE_SQL: dict[str, str] = {"op12_lexical": LEXICAL_SQL, "op13_exact_search": EXACT_SQL, "op2_neighbours": NEIGHBOURS_SQL, "op6_licenses": licenses.oracle_sql(), "op7_quality_rules": quality.oracle_sql()}
