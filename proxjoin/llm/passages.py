"""Removal of passages that stand elsewhere too, by suffix sorting of what can repeat.

1. Every window of ``length`` bytes has one anchor: the 32 bytes in it with the least hash. Equal windows have equal
   anchors at equal distance, so only windows whose anchors' bytes recur can repeat. A document gives a row for each
   anchor: the anchor's hash, and a BLAKE2 digest of the whole span of windows that it stands for.
2. Spans are counted by (anchor, digest) before any text moves. An anchor that recurs with one span only is a copy of
   that span, whose windows all repeat. Anchors that recur with different spans are open: one text for each different
   span goes, by the anchor's hash, to the shards.
3. Shards are suffix-sorted by external induction (``suffixes``), whose queues carry shared prefixes; neighbours that
   share ``length`` bytes repeat. A shard's queues go to disk beyond their budget. An anchor with more than ``split``
   different spans is no group of its own: its spans are cut into short runs of windows, dealt out by the bytes that
   all windows of a run share. Equal runs are counted before the sort, which gets one of them; where more than ``split``
   different ones of a key are left, their single windows are counted. So a key has at most ``split`` different pieces.
4. Repeated windows come back to their documents as intervals. Rows of common anchors are dealt out by a salt, too.

Counts are added up before rows move, so a passage that a third of the rows share is a few rows in each task.

Defined results: a null text is empty, and nothing is removed from texts shorter than ``length``. Repeated rows repeat
each other, and so lose every byte (from ``length`` bytes on). Ids may be null or repeated: rows are told apart by id
and the MD5 of the text. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proxjoin.llm.common import materialize, parcel, small_batches, unparcel
from proxjoin.llm.suffixes import repeated_starts

ANCHOR = 32
#: Windows of a run, where an anchor's spans are cut.
RUN = 16
#: Bytes of a shard's pieces: some times what the queues of its sort hold in memory.
SHARD_BYTES = 4 << 20
#: Rows of an anchor from which they are dealt out by a salt, and the number of salts.
COMMON, SALTS = 10_000, 64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _tables or len(_tables[base]) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _tables[base] = np.multiply.accumulate(out)
    return _tables[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _digest(span: bytes, anchor: int) -> bytes:
    """Of a span's bytes and the anchor's place in it."""
    return hashlib.blake2b(span, digest_size=8, salt=anchor.to_bytes(8, "little")).digest()


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text of at least ``length`` bytes: hash, digest of the span, first window, last window, place."""
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
    h = _mix((sums[ANCHOR:] - sums[:-ANCHOR]) * _power(_INVERSE, n - ANCHOR + 1))
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # of equal ones the first
    wide, reach = length - ANCHOR + 1, 1
    while reach < wide:
        step = min(reach, wide - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:] - 1, len(at) - 1]
    at = at[first]
    digests = b"".join(_digest(raw[x : y + length], z - x) for x, y, z in zip(first.tolist(), last.tolist(), at.tolist(), strict=True))
    return h[at], np.frombuffer(digests, "<u8"), first, last, at


def _anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    """(row, id, th, hs, spans, places) of each text with windows.

    A place is first << 24 | anchor - first << 12 | last - first.
    """
    if length - ANCHOR + 1 > 1 << 12:
        raise ValueError("windows are too long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, th, raw in zip(batch.column("id").to_pylist(), batch.column("th").to_pylist(), batch.column("raw"), strict=True):
                row += 1
                if raw.as_py() is None or len(raw.as_buffer()) < length:
                    continue
                h, span, first, last, at = anchors(raw.as_buffer().to_pybytes(), length)
                for c, v in zip(out, (row, i, th, h.view("<i8"), span.view("<i8"), first << 24 | (at - first) << 12 | (last - first)), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string()] + [pa.list_(pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["row", "id", "th", "hs", "spans", "places"])

    return keyed.mapInArrow(run, "row long, id long, th string, hs array<long>, spans array<long>, places array<long>")


def _pieces(raw: bytes, want: list, length: int, split: int) -> Iterator[tuple[int, int, bytes, bool]]:
    """(key, start, bytes, whether it is a run) of each open span; a span of a common anchor in runs, by their shared bytes."""
    for h, place, kinds in want:
        first, anchor, wide = place >> 24, place >> 12 & 0xFFF, place & 0xFFF
        if kinds <= split:
            yield h, first, raw[first : first + wide + length], False
            continue
        # Equal windows stand equally far before the anchor, so runs are counted back from it. All windows of a whole
        # run share the bytes from its last start to its first end, also where a text has only some of its windows.
        for k in range((anchor - wide) // RUN, anchor // RUN + 1):
            low, high = anchor - k * RUN - RUN + 1, anchor - k * RUN
            a, b = first + max(0, low), first + min(wide, high)
            core = hashlib.blake2b(raw[first + high : first + low + length], digest_size=8, key=h.to_bytes(8, "little", signed=True) + k.to_bytes(2, "little"))
            yield int.from_bytes(core.digest(), "little", signed=True), a, raw[a : b + length], True


def _counted(pieces: DataFrame, length: int, split: int) -> tuple[DataFrame, DataFrame]:
    """The pieces to be sorted, and (row, start, end) of the windows of runs that counting alone tells.

    Equal runs are counted: all their windows repeat, and one of them, without a row, is sorted with the others of its
    key. Where more than ``split`` different runs of a key are left, their single windows are counted instead.
    """
    runs = pieces.where("run")
    distinct = materialize(runs.groupBy("k", "piece").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("start").alias("start")))
    crowded = materialize(distinct.groupBy("k").agg(F.count("*").alias("kinds")).where(F.col("kinds") > split).select("k"))
    twice = materialize(distinct.where("n > 1").select("k", "piece"))
    whole = runs.join(twice, ["k", "piece"]).select("row", "start", (F.col("start") + F.length("piece")).alias("end"))
    one = distinct.select("k", F.when(F.col("n") == 1, F.col("row")).alias("row"), "start", "piece")
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("piece") - (length - 1)), lambda i: F.md5(F.substring("piece", i, length)))).alias("i", "window")
    windows = materialize(one.join(crowded, "k").select("k", "row", "start", at))
    again = materialize(windows.groupBy("k", "window").agg(F.count("*").alias("n")).where("n > 1").select("k", "window"))
    single = windows.where("row IS NOT NULL").join(again, ["k", "window"]).select("row", (F.col("start") + F.col("i")).alias("start"), (F.col("start") + F.col("i") + length).alias("end"))
    rest = pieces.where("NOT run").select("k", "row", "start", "piece").unionByName(one.join(crowded, "k", "left_anti").select("k", "row", "start", "piece"))
    return rest, whole.unionByName(single)


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, split: int = 20_000, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """The documents as (id, th, zipped text, the columns of ``docs``), and (id, th, starts, ends) of the repeated runs.

    Runs of one document may overlap; ends are those of the last windows.
    """
    small_batches(docs.sparkSession)
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    identity = [F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("id"), F.md5(raw).alias("th")]
    keyed = docs.select(*identity, raw.alias("raw"))
    stored = materialize(_anchor_rows(keyed, length))
    every = stored.select("row", F.inline(F.arrays_zip(F.col("hs").alias("h"), F.col("spans").alias("span"), F.col("places").alias("place"))).alias("h", "span", "place"))

    # Sums are stored before they are joined: Spark splits a hot key's partition only where both sides come from a shuffle.
    heads = every.groupBy("h").agg(F.count("*").alias("n"), F.min("span").alias("low"), F.max("span").alias("high")).where("n > 1")
    heads = materialize(heads.select("h", (F.col("low") != F.col("high")).alias("open"), (F.col("n") > COMMON).alias("common")))
    again = materialize(every.join(heads, "h"))
    mixed = again.where("open")
    spans = mixed.groupBy("h", "span", "common").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one"))
    spans = materialize(spans)
    salt = F.when(F.col("common"), F.pmod(F.xxhash64("row", "place"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(F.col("common"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    twice = spans.where("n > 1").select("h", "span", F.explode(salts).alias("salt"))
    kinds = materialize(spans.groupBy("h").agg(F.count("*").cast("int").alias("kinds")))
    wanted = spans.join(kinds, "h").groupBy(F.col("one.row").alias("row")).agg(F.collect_list(F.struct("h", "one.place", "kinds")).alias("want"))
    whole = again.where("NOT open").select("row", "place").unionByName(mixed.withColumn("salt", salt).join(twice, ["h", "span", "salt"]).select("row", "place"))

    asked = wanted.join(stored.select("row", "id", "th"), "row").groupBy("id", "th").agg(F.min(F.struct("row", "want")).alias("w")).select("id", "th", "w.row", "w.want")
    zipped = _zipped(keyed)
    texts = zipped.join(asked, ["id", "th"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, packed, want in zip(batch.column("row").to_pylist(), batch.column("zipped").to_pylist(), batch.column("want").to_pylist(), strict=True):
                out += [(k, row, s, piece, run) for k, s, piece, run in _pieces(zlib.decompress(packed), [(w["h"], w["place"], w["kinds"]) for w in want], length, split)]
            if out:
                k, r, s, p, u = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(p, pa.binary()), pa.array(u, pa.bool_())], ["k", "row", "start", "piece", "run"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found() -> pa.RecordBatch:
            rows, starts, ends = [], [], []
            for (_, row, start, _), hit in zip(held, repeated_starts([x[3] for x in held], length), strict=True):
                edges = np.flatnonzero(np.diff(np.r_[False, hit, False]))
                rows += [row] * (len(edges) // 2)
                starts += [start + int(e) for e in edges[::2]]
                ends += [start + int(e) - 1 + length for e in edges[1::2]]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, starts, ends)], ["row", "start", "end"])

        size = 0
        for batch in batches:
            for item in zip(*(batch.column(c).to_pylist() for c in ("k", "row", "start", "piece")), strict=True):
                if size >= shard_bytes and item[0] != held[-1][0]:  # spans of one key stay together
                    yield found()
                    held, size = [], 0
                held.append(item)
                size += len(item[3])
        if held:
            yield found()

    pieces = texts.select("row", "zipped", "want").mapInArrow(cut, "k long, row long, start long, piece binary, run boolean")
    counted = None
    if kinds.where(F.col("kinds") > split).limit(1).count():
        pieces = materialize(pieces)
        pieces, counted = _counted(pieces, length, split)
    hits = pieces.select("k", "row", "start", "piece").repartition("k").sortWithinPartitions("k").mapInArrow(search, "row long, start long, end long")
    hits = hits.where("row IS NOT NULL")
    hits = hits.unionByName(counted) if counted is not None else hits
    first, wide = F.shiftright("place", 24), F.col("place").bitwiseAND(F.lit(0xFFF))
    runs = hits.unionByName(whole.select("row", first.alias("start"), (first + wide + length).alias("end")))
    runs = runs.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    runs = runs.join(stored.select("row", "id", "th"), "row").groupBy("id", "th").agg(F.min("runs").alias("runs"))
    return zipped, materialize(runs)


def _zipped(keyed: DataFrame) -> DataFrame:
    """Texts move between executors compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([zlib.compress(x, 1) for x in batch.column("raw").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if n == "raw" else batch.column(n) for n in batch.schema.names], ["zipped" if n == "raw" else n for n in batch.schema.names])

    fields = [T.StructField("zipped", T.BinaryType()) if f.name == "raw" else f for f in keyed.schema]
    return keyed.mapInArrow(run, T.StructType(fields))


def removed_runs(runs: list | None) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((r["start"], r["end"]) for r in runs or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _remove(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for r in runs for x in r), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    _, runs = repeated_passages(docs, key, text, length)
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    keyed = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("id"), F.md5(raw).alias("th"), raw.alias("raw"))
    joined = _zipped(keyed).join(runs, ["id", "th"], "left").select("doc_id", "zipped", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for packed, found in zip(batch.column("zipped").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                text_bytes, spans = zlib.decompress(packed), removed_runs(found)
                kept = _remove(text_bytes, spans)
                out.append((len(text_bytes), len(text_bytes) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            n, r, s, d = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(d, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, size: str | None = "n_chars") -> DataFrame:
    """``docs`` without the repeated passages. Bytes left of a character that was cut go too; null texts stay null."""
    _, runs = repeated_passages(docs, key, text, length)
    raw = F.coalesce(F.col("_text").cast("binary"), F.lit(b""))
    keyed = parcel(docs, text).select(F.coalesce(F.col("_row").getField(key).cast("long"), F.lit(-1)).alias("_id"), F.md5(raw).alias("_th"), F.col("_text").isNull().alias("_null"), raw.alias("raw"), "_row")
    joined = _zipped(keyed).join(runs.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "runs"), ["_id", "_th"], "left").select("_null", "zipped", "runs", "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for null, packed, found in zip(*(batch.column(c).to_pylist() for c in ("_null", "zipped", "runs")), strict=True):
                out.append(None if null else _remove(zlib.decompress(packed), removed_runs(found)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.string())], ["_row", "_text"])

    out = joined.mapInArrow(run, T.StructType([keyed.schema["_row"], T.StructField("_text", T.StringType())]))
    return unparcel(out, docs, text, size)
