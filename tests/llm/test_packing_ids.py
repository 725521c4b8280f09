"""Ids are those of the plain call of tokenizers on the file, added tokens included."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from proxjoin.llm import packing
from proxjoin.llm.queries import tokenizer_path

PLAIN = Tokenizer.from_file(tokenizer_path())
TEXTS = ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "日本 <|endoftext|> x", "", None, "x" * 30_000 + "<|endoftext|>", "a b"]


@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", "a", " ", "é", "日", "\n", "'s", "1"]), max_size=12).map("".join))
@settings(max_examples=200, deadline=None)
def test_ids_are_the_plain_calls(text):
    assert packing.encoder(tokenizer_path()).ids(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_pieces_hold_the_plain_calls_ids(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").repartition(3)
    want = {i: [*PLAIN.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(TEXTS)}
    pieces = packing.pack(docs, tokenizer_path()).collect()
    assert {p.doc_id: p.doc_tokens for p in pieces} == {i: len(x) for i, x in want.items()}
    assert all(p.ids_crc32 == zlib.crc32(np.array(want[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) for p in pieces)
    assert 50256 in want[0]
