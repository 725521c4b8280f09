"""Every opN_ query as it is registered, over the small tables: columns, whole tables, and the SQL where there is some."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from proxjoin.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_html": ("pages", "page_id", ["page_id", "url", "text", "n_chars"]),
    "op2_neighbours": (None, None, ["query_id", "rank", "vec_id", "score"]),
    "op3_sharding": ("documents", "doc_id", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]),
    "op4_simhash": ("documents", "doc_id", ["doc_id", "fingerprint", "component_id"]),
    "op5_mixing": ("documents", "doc_id", ["doc_id", "size", "source_size", "target", "taken"]),
    "op6_licenses": ("documents", "doc_id", ["doc_id", "licenses"]),
    "op7_quality_rules": ("documents", "doc_id", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
    "op8_packing": (None, None, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]),
    "op9_passages": ("documents", "doc_id", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    "op10_importance": ("documents", "doc_id", ["doc_id", "kept"]),
    "op11_whitening": (None, None, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]),
    "op12_lexical": (None, None, ["item_id", "rank", "doc_id", "score"]),
    "op13_exact_search": (None, None, ["query_id", "rank", "vec_id", "score"]),
}


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    frame = entry.queries()[name](spark, FOLDER)
    table, key, columns = COLUMNS[name]
    assert frame.columns[: len(columns)] == columns or set(columns) <= set(frame.columns)
    rows = frame.collect()
    if table:
        assert sorted(r[key] for r in rows) == sorted(r[key] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect())
    if name == "op4_simhash":
        assert all(len(r.fingerprint) == 16 and int(r.fingerprint, 16) >= 0 and r.component_id <= r.doc_id for r in rows)
    if name == "op8_packing":
        docs = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
        assert {r.doc_id for r in rows} == docs and all(0 <= r.offset and r.offset + r.length <= 1024 for r in rows)
    if sql := entry.oracle_sql().get(name):
        con = duckdb.connect()
        for t in ("documents", "embeddings", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(frame.columns)
        want = sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in result.fetchall())
        assert sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in rows) == want
