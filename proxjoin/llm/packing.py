"""Packing by concatenation: all documents' ids end to end, cut into windows of fixed length.

Pass one writes each document's ids with its place in its partition, and each partition's total; prefix sums over the
totals, of which there is one per partition, give global offsets; pass two cuts without moving any row. Only the last
window is not full.

Defined results: a null or empty text has only the end id. Repeated rows are packed each. An empty table gives no
pieces. Strings that name the file's added tokens become those tokens, as the tokenizer has it by default.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxjoin.llm.common import materialize, small_batches

_loaded: dict = {}

#: The pattern of byte-level pre-tokenisation (a fixed value of that public format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point, letters, numbers and white space are the same in every version of Unicode.
SETTLED = "\u0250"


class Encoder:
    """The ids that the tokenizer file ``path`` gives to texts.

    A plain byte-level BPE (no normaliser, no prefix space, each id in the order of its merge) is also run as ranks by
    tiktoken, which gives the same ids several times as fast. Texts with characters whose classes the two libraries'
    tables might tell apart, those that hold an added token's string, and files of other kinds go through tokenizers
    itself.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.size = self.plain.get_vocab_size()
        spec = json.loads(self.plain.to_str())
        self.added = [x["content"] for x in spec.get("added_tokens", ())]
        self.fast = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict):
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
        vocab = {t: i for t, i in model["vocab"].items() if t not in {x["content"] for x in spec.get("added_tokens", ())}}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or [vocab.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))) or len(vocab) != 256 + len(merges):
            return None
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level files write as themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocab.items()}, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and (text.isascii() or max(text) < SETTLED) and not any(x in text for x in self.added):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)


def encoder(path: str) -> Encoder:
    """The encoder of ``path``, loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def tokenize(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """(doc_id, part, before, n, ids): ids as little-endian 16-bit numbers; ``before`` counts the partition's earlier ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before, end = encoder(path).ids, TaskContext.get().partitionId(), 0, np.array([end_id], "<u2").tobytes()
        for batch in batches:
            ids, n, starts = [], [], []
            for x in batch.column("text").to_pylist():
                ids.append((encode(x).astype("<u2").tobytes() if x else b"") + end)
                n.append(len(ids[-1]) // 2)
                starts.append(before)
                before += n[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "part", "before", "n", "ids"])

    if encoder(path).size > 1 << 16:
        raise ValueError("ids must fit in 16 bits")
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, part int, before long, n long, ids binary")


def pack(docs: DataFrame, path: str, window: int = 1024, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    stored = materialize(tokenize(docs, path, key, text, end_id))
    totals = stored.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            out: list[tuple] = []
            for doc, at, raw in zip(batch.column("doc_id").to_pylist(), batch.column("at").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_buffer(), "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, len(ids) - start)
                    out.append((doc, start, length, zlib.crc32(ids[start : start + length]), len(ids), sequence, offset))
                    start += length
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    small_batches(docs.sparkSession)
    # One row per partition of the first pass, 12 bytes each.
    placed = stored.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "ids")
    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
