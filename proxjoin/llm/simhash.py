"""SimHash near-duplicates by bit-sliced comparison.

A pair of 64-bit fingerprints within two bits agrees on at least six of its eight bytes. So each distinct fingerprint
goes to 28 buckets, one for each choice of six bytes, and a bucket holds at most 65,536 distinct fingerprints, however
many documents there are. Inside a bucket, bit planes are stored vertically: one machine word of a plane has a bit for
each of 64 fingerprints (or pairs), carry-save counters add up differing bits for all of them at once, and a block is
left as soon as all its distances exceed the radius. A bucket gives a spanning star of each of its components, never
all pairs.

Defined results: a null or empty text has no words and fingerprint zero, which links like any other. Copies share a
fingerprint, so they are compared once. Rows without an id link as others do; a component's id is its least id that is
not null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxjoin.llm.common import materialize, parcel, small_batches, unparcel
from proxjoin.llm.graph import components

BITS, RADIUS = 64, 2
#: Keeps the bytes on which the fingerprints of a bucket agree.
MASKS = [((1 << BITS) - 1) ^ (0xFF << 8 * i) ^ (0xFF << 8 * j) for i, j in combinations(range(8), 2)]
#: Buckets up to this size are compared together, along diagonals; larger ones each alone.
SMALL = 48


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit b is 1 if it is set in over half the XXH64 of the text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and white space of ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle, len(words))
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends[: len(words) - width]]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :], strict=True)], "<u8")
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, fp), a row for each row; th is a hash of the text, fp the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fps)], ["doc_id", "th", "fp"])

    small_batches(docs.sparkSession)
    picked = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text}`").alias("th"), F.col(f"`{text}`").alias("text"))
    return picked.mapInArrow(run, "doc_id long, th long, fp long")


def near(differing: Iterator[np.ndarray], radius: int = RADIUS) -> np.ndarray:
    """Which lanes have at most ``radius`` (0 to 3) bits set in the planes, all lanes of a word at once."""
    ones = twos = over = None
    for plane in differing:
        if ones is None:
            ones, twos, over = plane.copy(), np.zeros_like(plane), np.zeros_like(plane)
            continue
        carry = ones & plane
        ones ^= plane
        over |= twos & carry
        twos ^= carry
        if radius < 3 and not np.bitwise_not(over | (ones & twos if radius == 2 else twos)).any():
            break  # all exceed the radius
    beyond = over | {0: ones | twos, 1: twos, 2: ones & twos, 3: np.zeros_like(ones)}[radius]
    return np.bitwise_not(beyond)


def _at_most(counters: list[np.ndarray], bound: int) -> np.ndarray:
    """Lanes whose number, given by its bits in the counters, is ``bound`` at most."""
    less, equal = np.zeros_like(counters[0]), np.full_like(counters[0], np.iinfo(counters[0].dtype).max)
    for i in range(max(len(counters), bound.bit_length()) - 1, -1, -1):
        bit = counters[i] if i < len(counters) else np.zeros_like(less)
        if bound >> i & 1:
            less |= equal & ~bit
            equal &= bit
        else:
            equal &= ~bit
    return less | equal


def within(differing: Iterator[np.ndarray], radius: int, block: int = 16) -> np.ndarray:
    """Which lanes have at most ``radius`` bits set in the planes, for any radius: bit-sliced counters, all lanes at once.

    Left after any ``block`` of planes as soon as all lanes exceed the radius.
    """
    counters: list[np.ndarray] = []
    for k, plane in enumerate(differing, 1):
        carry = plane
        for i, counter in enumerate(counters):
            counters[i], carry = counter ^ carry, counter & carry
        if not counters or carry.any():
            counters.append(carry.copy())
        if k % block == 0 and not _at_most(counters, radius).any():
            break
    return _at_most(counters, radius)


def _planes(values: np.ndarray) -> np.ndarray:
    """Row b has bit b of every value, eight values in a byte."""
    return np.packbits(np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T, axis=1, bitorder="little")


def _pairs_of_runs(fps: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs inside small runs: the k-th diagonal compares each value with the one k places on."""
    left, right, at = [], [], np.arange(len(fps))
    for k in range(1, SMALL):
        at = at[: np.searchsorted(at, len(fps) - k)]
        at = at[run[at] == run[at + k]]
        if not len(at):
            break
        planes = _planes(fps[at] ^ fps[at + k])
        hit = np.unpackbits(near(iter(planes), radius), count=len(at), bitorder="little").astype(bool)
        left.append(at[hit])
        right.append(at[hit] + k)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _pairs_of_bucket(fps: np.ndarray, radius: int, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of one bucket: blocks of its values against the planes of all that follow."""
    left, right = [], []
    planes = _planes(fps)
    varied = [b for b in range(BITS) if planes[b].any() and np.bitwise_not(planes[b]).any()]
    wide = -(-planes.shape[1] // 8) * 8
    planes = np.ascontiguousarray(np.pad(planes, ((0, 0), (0, wide - planes.shape[1])))).view("<u8")
    for k in range(0, len(fps), block):
        some = fps[k : k + block]
        since = k // 64
        flip = {b: (np.uint64(0) - ((some >> np.uint64(b)) & np.uint64(1)))[:, None] for b in varied}
        lanes = near((planes[b, since:][None, :] ^ flip[b] for b in varied), radius)
        i, j = np.nonzero(np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little"))
        i, j = i + k, j + since * 64
        later = (j > i) & (j < len(fps))
        left.append(i[later])
        right.append(j[later])
    return np.concatenate(left), np.concatenate(right)


def stars(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least place that each of n places reaches by the pairs."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def bucket_links(fps: np.ndarray, table: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, least of its component) in whole buckets; rows lie sorted by table and masked value, without repeats."""
    masked = fps & np.array(MASKS, "<u8")[table]
    fresh = np.r_[True, (masked[1:] != masked[:-1]) | (table[1:] != table[:-1])]
    run, begin = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    length = np.diff(np.r_[begin, len(fps)])
    small = np.flatnonzero((length[run] > 1) & (length[run] <= SMALL))
    a, b = _pairs_of_runs(fps[small], run[small], radius)
    found = [(small[a], small[b])]
    for r in np.flatnonzero(length > SMALL):
        a, b = _pairs_of_bucket(fps[begin[r] : begin[r] + length[r]], radius)
        found.append((a + begin[r], b + begin[r]))
    left, right = (np.concatenate(x) for x in zip(*found, strict=True))
    root = stars(len(fps), left, right)
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that join just the fingerprints (fp, without repeats) that chains of near pairs join."""
    if radius > 2:
        raise ValueError("six bytes agree for a radius of 2 at most")
    signed = [m - (1 << 64) if m >> 63 else m for m in MASKS]
    rows = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).cast("short").alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("masked")) for t, m in enumerate(signed)])).alias("k"))
    rows = rows.select("fp", "k.table", "k.masked")
    # Told apart by hash, so that the tables' equal keys don't meet; no number is given, so partitions follow the session's setting.
    rows = rows.repartition(F.col("table"), F.col("masked")).sortWithinPartitions("table", "masked").select("fp", "table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_fp, held_table = np.zeros(0, "<u8"), np.zeros(0, np.int64)

        def out(fp, table):
            a, b = bucket_links(fp, table, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], ["a", "b"])

        masks = np.array(MASKS, "<u8")
        for batch in batches:
            held_fp = np.concatenate([held_fp, batch.column("fp").to_numpy(zero_copy_only=False).view("<u8")])
            held_table = np.concatenate([held_table, batch.column("table").to_numpy(zero_copy_only=False).astype(np.int64)])
            if len(held_fp) < 20_000:
                continue
            masked = held_fp & masks[held_table]
            last = np.flatnonzero((masked != masked[-1]) | (held_table != held_table[-1]))
            if len(last):  # the last bucket may go on in the next batch
                cut = last[-1] + 1
                yield out(held_fp[:cut], held_table[:cut])
                held_fp, held_table = held_fp[cut:], held_table[cut:]
        if len(held_fp):
            yield out(held_fp, held_table)

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, fp, root, component_id), a row for each row of ``docs``; root is the component's least fingerprint."""
    prints = materialize(fingerprints(docs, key, text))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp")))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(groups, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", near: Callable[[DataFrame, str, str], DataFrame] = near_duplicates) -> DataFrame:
    """One row of each component: that with the least id (null last), then the least hash of its text.

    Rows are stored with a number each; only numbers, ids and hashes are grouped, and texts are looked up once.
    """
    rows = materialize(parcel(docs, text).select("_row", "_text", F.monotonically_increasing_id().alias("_n")))
    found = near(rows.select("_n", "_text"), "_n", "_text").select(F.col("doc_id").alias("_n"), "th", "root")
    keys = rows.select("_n", F.col("_row").getField(key).cast("long").alias("_key"))
    first = F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "th", "_n")).alias("first")
    heads = found.join(keys, "_n").groupBy("root").agg(first).select(F.col("first._n").alias("_n"))
    return unparcel(rows.join(heads, "_n", "left_semi"), docs, text)
