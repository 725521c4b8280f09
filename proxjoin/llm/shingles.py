"""Near-duplicates by SimHash and exact Jaccard similarity of word shingles: 5 words, 0.8 or more.

At a similarity of 0.8 about 15 % of a SimHash's bits differ, which is too many to block by given bits: keys of 27 bits
agree in 1 of 80 tables. But it is bits with narrow majorities that differ. So a long SimHash is counted, of 256 groups of
256 bits, and of each group only the strongest bit stands in a key: its place and its value. At 0.8 the strongest bits of
a group agree in 3 of 8 cases, and in 1 of 512 by chance. A key is those of three groups, 27 bits; each set goes to 255
tables, in which every group stands thrice (one twice). At 0.8 a pair meets in 13 tables on average, and in none with a
chance of some 3 in 100,000; at 0.85 and above that is much less.

All votes of a shingle are signs of Walsh functions of its hash, so the votes for 65,536 bits are counted by a fast
Walsh-Hadamard transform instead of one by one.

In each bucket of a table, 128-bit SimHashes are compared, bit planes of all pairs at once, and abandoned above 52
differing bits (at 0.8 about 19 differ, 24 for very small sets, with a deviation of about 4). Buckets of more than 256
sets go on whole. What is left is decided by the shingle sets themselves. Documents of one set are compared once.

First each set meets the least set that it is near to in a bucket, its hub, so that a large group of near copies falls
into few components in one pass. Then only hubs whose sets still lie in several components count. What they connect is a
family: its sets are dealt into blocks of bounded bytes, and pairs of blocks are compared, but for pairs of blocks of the
family's largest component. In a pair of blocks, two sets of a similarity of 0.8 share one of their rarest fifth of
shingles, so others are never met; SimHashes decide next, then the sets. A task tells spanning links, never all pairs,
and each set is shipped once for each block that its own meets (once in all where the family fits one block).

Defined results: a text of less than five words is one shingle; null and empty texts are one set. Rows without an id
link as others do. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxjoin.llm.common import BATCH_ROWS, materialize, small_batches
from proxjoin.llm.graph import components
from proxjoin.llm.simhash import stars, within

WORDS = 5
#: Hubs that a set meets first; bytes of the shingles of a block of a family; pairs compared at once.
LEADERS, BLOCK, AT_ONCE = 1, 16 << 20, 4096
#: Differing bits of two SimHashes of 128 bits up to which a pair is decided by its sets.
RADIUS = 52
#: Bits of a group of the long SimHash; hashes of a shingle; groups that share one of them. Bits of a strongest bit's name.
WIDTH, ROUNDS, SHARING, NAME = 256, 8, 32, 9
#: Buckets up to this size are compared by SimHashes.
MET = 256
_rnd = np.random.default_rng(42)
_FACTORS = _rnd.integers(0, 1 << 63, (ROUNDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rnd.integers(0, 1 << 63, (ROUNDS, 1), dtype=np.uint64)
#: The three groups of each table's keys.
TABLES = np.concatenate([_rnd.permutation(ROUNDS * SHARING)[:255].reshape(-1, 3) for _ in range(3)])
#: Walsh functions of the numbers below ``SHARING``, and their opposites.
_WALSH = np.array([[1 - 2 * ((i & g).bit_count() & 1) for g in range(SHARING)] for i in range(SHARING)], np.int16)
_WALSH = np.concatenate([_WALSH, -_WALSH])
_PLACES = np.arange(WIDTH, dtype=np.int32)[:, None] << 1


def shingle_set(text: str | None) -> np.ndarray:
    """XXH64 of the text's word shingles, sorted, without repeats."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    width = min(WORDS, len(words))
    starts = [0, *[e + 1 for e in ends[: len(words) - width]]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e]) for s, e in zip(starts, ends[width - 1 :], strict=True)], "<u8"))


def simhash_128(shingles: np.ndarray) -> bytes:
    """Bit b is 1 if it is set in over half the shingles' hashes, of 64 bits and of 64 more made of them."""
    if not len(shingles):
        return bytes(16)
    more = (shingles ^ (shingles >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    more ^= more >> np.uint64(32)
    counts = np.zeros(128, np.int64)
    both = np.column_stack([shingles, more])
    for k in range(0, len(both), 2048):
        counts += np.unpackbits(np.ascontiguousarray(both[k : k + 2048]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(both), bitorder="little").tobytes()


def votes(shingles: np.ndarray) -> np.ndarray:
    """The long SimHash's sums, by bit of a group and group: for each bit, shingles for it less those against it.

    Groups share a hash by ``SHARING``. A shingle's vote for bit w of the g-th of them is the sign of Walsh functions w and g
    of its hash. Votes are added up by w's argument first, which leaves a Walsh-Hadamard transform along it.
    """
    mixed = shingles * _FACTORS + _TERMS
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    places = ((mixed & np.uint64(WIDTH - 1)) * np.uint64(ROUNDS) + np.arange(ROUNDS, dtype=np.uint64)[:, None]).ravel().astype(np.int16)
    signs = ((mixed >> np.uint64(20)) & np.uint64(2 * SHARING - 1)).ravel().astype(np.int8)
    kind = np.int16 if len(shingles) < 1 << 15 else np.int32
    sums = np.zeros((WIDTH * ROUNDS, SHARING), kind)
    order = np.argsort(places, kind="stable")
    start = np.flatnonzero(np.r_[True, places[order[1:]] != places[order[:-1]]])
    left = np.diff(np.r_[start, len(order)])
    while len(start):  # one vote of each place at a time
        some = order[start]
        sums[places[some]] += _WALSH[signs[some]]
        left -= 1
        start, left = start[left > 0] + 1, left[left > 0]
    spare = np.empty(sums.size // 2, kind)
    step = ROUNDS * SHARING
    while step < sums.size:
        halves, less = sums.reshape(-1, 2, step), spare.reshape(-1, step)
        np.subtract(halves[:, 0], halves[:, 1], out=less)
        halves[:, 0] += halves[:, 1]
        halves[:, 1] = less
        step *= 2
    return sums.reshape(WIDTH, ROUNDS * SHARING)


def strongest(shingles: np.ndarray) -> np.ndarray:
    """The bit with the largest majority of each group, the last of equal ones: twice its place, and 1 if most are against it."""
    if not len(shingles):
        return np.zeros(0, np.uint16)
    sums = votes(shingles)
    named = np.abs(sums).astype(np.int32 if sums.itemsize == 2 else np.int64)
    named <<= NAME
    named |= _PLACES
    named |= sums < 0
    return (named.max(axis=0) & ((1 << NAME) - 1)).astype(np.uint16)


def table_keys(bits: np.ndarray) -> np.ndarray:
    """A key for each row of strongest bits and each table: the table's number and its three groups' bits."""
    keys = np.arange(len(TABLES), dtype=np.int64)[None, :]
    for k in range(3):
        keys = keys << NAME | bits[:, TABLES[:, k]]
    return keys


def _prints(rows: DataFrame, number: str, text: str) -> DataFrame:
    """(doc_id, th, id, bytes, bits, fp), a row for each row; id is a hash of the set, bits its strongest bits, fp its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x) for x in batch.column("text").to_pylist()]
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view("<i8")
            columns = [batch.column("doc_id"), batch.column("th"), pa.array(ids, pa.int64()), pa.array([s.nbytes for s in sets], pa.int64()), pa.array([strongest(s).tobytes() for s in sets], pa.binary()), pa.array([simhash_128(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "id", "bytes", "bits", "fp"])

    small_batches(rows.sparkSession)
    picked = rows.select(F.col(f"`{number}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("th"), F.col(f"`{text}`").alias("text"))
    return picked.mapInArrow(run, "doc_id long, th long, id long, bytes long, bits binary, fp binary")


def _entries(sets: DataFrame) -> DataFrame:
    """(id, key): each of the sets (id, bits), which are told once, in all tables. Empty sets are in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint16).reshape(-1, ROUNDS * SHARING)
                ids = np.repeat(part.column("id").to_numpy(), len(TABLES))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(table_keys(bits).ravel())], ["id", "key"])

    return sets.where(F.length("bits") > 0).select("id", "bits").mapInArrow(run, "id long, key long")


def _shared(entries: DataFrame) -> DataFrame:
    """The entries whose key others have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, False  # the last row, and whether an earlier one has its key
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if last is None else pa.concat_batches([last, batch])
            keys = rows.column("key").to_numpy()
            same = keys[1:] == keys[:-1]
            keep = np.r_[known, same] | np.r_[same, False]
            yield rows.filter(pa.array(np.r_[keep[:-1], False]))
            last, known = rows.slice(len(keep) - 1), bool(keep[-1])
        if last is not None and known:
            yield last

    # Told apart by hash; no number is given, so partitions follow the session's setting.
    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(run, "id long, key long")


def bucket_hubs(ids: np.ndarray, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (hub, id) in whole buckets, whose rows lie sorted by key and id: the hub is the least id that chains of near
    SimHashes join to an id in a bucket. Buckets of more than ``MET`` sets have one hub."""
    fresh = np.r_[True, keys[1:] != keys[:-1]]
    run, begin = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    length = np.diff(np.r_[begin, len(keys)])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.flatnonzero((length[run] > 1) & (length[run] <= MET))
    for k in range(1, MET):  # the k-th diagonal compares each set with the one k places on
        at = at[: np.searchsorted(at, len(ids) - k)]
        at = at[run[at] == run[at + k]]
        if not len(at):
            break
        hit = at[_lanes(prints[at], prints[at + k])]
        left.append(hit)
        right.append(hit + k)
    root = stars(len(ids), np.concatenate(left), np.concatenate(right))
    root = np.where(length[run] > MET, begin[run], root)
    linked = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[linked]], ids[linked]


def _hubs(shared: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, id): hubs a of the sets in the buckets of the entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(hubs: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(ids, pa.int64())], ["a", "id"])

        ids, keys, prints = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 16), np.uint8)
        long: tuple[int, int] | None = None  # key and hub of a bucket of more than MET sets that goes on
        for batch in batches:
            ids = np.concatenate([ids, batch.column("id").to_numpy()])
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            prints = np.concatenate([prints, _prints_of(batch.column("fp").to_pylist())])
            if long is not None:
                n = int(np.searchsorted(keys, long[0], side="right"))
                yield out(np.full(n, long[1]), ids[:n])
                ids, keys, prints = ids[n:], keys[n:], prints[n:]
            if not len(keys):
                continue
            long = None
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
            if len(keys) - cut > MET:
                long, cut = (int(keys[-1]), int(ids[cut])), len(keys)
            if cut:
                yield out(*bucket_hubs(ids[:cut], keys[:cut], prints[:cut]))
            ids, keys, prints = ids[cut:], keys[cut:], prints[cut:]
        if len(keys):
            yield out(*bucket_hubs(ids, keys, prints))

    met = shared.join(wanted.select("id", "fp"), "id").select("id", "key", "fp")
    return met.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "a long, id long").distinct()


def _sets(rows: DataFrame, number: str, text: str, wanted: DataFrame) -> DataFrame:
    """(id, fp, shingles) of the wanted (id, n, fp): made of the texts again, as most rows' sets are never asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(x).tobytes() for x in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fp"), sets], ["id", "fp", "shingles"])

    met = rows.select(F.col(f"`{number}`").alias("n"), F.col(f"`{text}`").alias("text")).join(wanted, "n")
    return met.select("id", "fp", "text").mapInArrow(run, "id long, fp binary, shingles binary")


def _lanes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of SimHashes differ in ``RADIUS`` bits at most: planes of all pairs, counted together."""
    planes = np.packbits(np.unpackbits(x ^ y, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return np.unpackbits(within(iter(planes), RADIUS), count=len(x), bitorder="little").astype(bool)


def _prints_of(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), 16)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of 0.8 or more."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 or more, those with far SimHashes left out first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = _lanes(_prints_of(batch.column("fa").to_pylist()), _prints_of(batch.column("fb").to_pylist()))
            left, right = batch.column("sa"), batch.column("sb")
            for k in np.flatnonzero(keep):
                keep[k] = _similar(np.frombuffer(left[k].as_py(), "<u8"), np.frombuffer(right[k].as_py(), "<u8"))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda c: sets.select(F.col("id").alias(c), F.col("fp").alias(f"f{c}"), F.col("shingles").alias(f"s{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "fa", "fb", "sa", "sb").mapInArrow(run, "a long, b long")


def _links(ids: list[int], own: list[int], roots: list[int], prints: list[bytes], sets: list[bytes]) -> list[tuple[int, int]]:
    """Links (a, b) that, with the given components, connect all similar sets of a pair of blocks.

    Sets are alike only if they share one of the 1 in 5 shingles, and one more, that are rarest among these sets; sets of
    one component, or of one block where there are two, aren't compared.
    """
    two = len(set(own)) > 1
    apart, print_of = np.array(own), _prints_of(prints)
    shingles = [np.frombuffer(s, "<u8") for s in sets]
    sizes = np.array([len(s) for s in shingles])
    owner = np.repeat(np.arange(len(ids)), sizes)
    _, token, counts = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    rare = np.lexsort((token, counts[token], owner))
    place = np.arange(len(rare)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    chosen = rare[place < np.repeat(sizes - (4 * sizes + 4) // 5 + 1, sizes)]
    owner, token = owner[chosen], token[chosen]
    by_token = np.argsort(token, kind="stable")
    posted, start = owner[by_token], np.searchsorted(token[by_token], np.arange(len(counts) + 1))
    first = np.searchsorted(owner, np.arange(len(ids) + 1))
    names = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    group = np.array([names[r] for r in roots])
    links: list[tuple[int, int]] = []
    waiting: list[np.ndarray] = []

    def decide() -> None:
        pairs = np.concatenate(waiting)
        waiting.clear()
        for x, y in pairs[_lanes(print_of[pairs[:, 0]], print_of[pairs[:, 1]])].tolist():
            if group[x] != group[y] and _similar(shingles[x], shingles[y]):
                links.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                group[group == group[y]] = group[x]

    for x in range(len(ids)):
        met = np.zeros(len(ids), bool)
        for t in token[first[x] : first[x + 1]]:
            met[posted[start[t] : start[t + 1]]] = True
        met[: x + 1] = False
        met &= (group != group[x]) & (5 * np.minimum(sizes, sizes[x]) >= 4 * np.maximum(sizes, sizes[x]))
        if two:
            met &= apart != apart[x]
        if met.any():
            waiting.append(np.column_stack([np.full(int(met.sum()), x), np.flatnonzero(met)]))
            if sum(map(len, waiting)) >= AT_ONCE:
                decide()
    if waiting:
        decide()
    return links


def _inside(members: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links (a, b) between the components of families; ``members`` are (family, root, id, bytes)."""
    weights = members.groupBy("family", "root").agg(F.sum("bytes").alias("w"))
    plan = weights.groupBy("family").agg(F.sum("w").alias("all"), F.max(F.struct("w", "root")).alias("top"))
    need = lambda c: F.ceil(F.greatest(c, F.lit(1)) / block)
    whole = F.col("all") <= block
    plan = plan.select("family", F.col("top.root").alias("top"), F.when(whole, F.lit(1)).otherwise(need(F.col("all") - F.col("top.w"))).alias("few"), F.when(whole, F.lit(0)).otherwise(need(F.col("top.w"))).alias("many"))
    large = (F.col("root") == F.col("top")) & (F.col("many") > 0)
    spread = F.xxhash64("id")
    own = F.when(large, F.col("few") + F.pmod(spread, F.greatest("many", F.lit(1)))).otherwise(F.pmod(spread, F.col("few")))
    dealt = members.join(plan, "family").withColumn("own", own).withColumn("meets", F.sequence(F.lit(0), F.when(large, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1))
    dealt = dealt.select("family", "root", "id", "own", F.explode("meets").alias("k"))
    dealt = dealt.select("family", "root", "id", "own", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["family", "i", "j", "id", "own", "root", "fp", "shingles"]
        listed = (row for b in batches for row in zip(*[b.column(c).to_pylist() for c in names], strict=True))
        for _, group in groupby(listed, key=lambda row: row[:3]):
            found = _links(*map(list, zip(*[row[3:] for row in group], strict=True)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    met = dealt.join(sets, "id").select("family", "i", "j", "id", "own", "root", "fp", "shingles")
    return met.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "id").mapInArrow(run, "a long, b long")


def _in_large_batches(entries: DataFrame, rows: int = 16_384) -> DataFrame:
    """Stored; entries are short, unlike texts, so batches of them may have more rows."""
    conf = entries.sparkSession.conf
    before = conf.get(BATCH_ROWS)
    conf.set(BATCH_ROWS, str(rows))
    try:
        return materialize(entries)
    finally:
        conf.set(BATCH_ROWS, before)


def near_numbered(rows: DataFrame, number: str, text: str, leaders: int = LEADERS, block: int = BLOCK) -> DataFrame:
    """(doc_id, th, root), a row for each row of a stored table whose rows have a ``number`` each, here as doc_id."""
    prints = materialize(_prints(rows, number, text))
    firsts = prints.groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    entries = _entries(prints.join(firsts.select("doc_id"), "doc_id", "left_semi"))
    shared = _in_large_batches(_shared(entries))
    asked = shared.select("id").distinct()
    wanted = prints.join(asked, "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("n"), F.min("bytes").alias("bytes"), F.min("fp").alias("fp"))
    wanted = materialize(wanted)
    met = _in_large_batches(_hubs(shared, wanted))
    asked = met.select(F.explode(F.array("a", "id")).alias("id")).distinct()
    sets = materialize(_sets(rows, number, text, wanted.join(asked, "id", "left_semi").select("id", "n", "fp")))
    hubs = met.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("a")), 1, leaders).alias("as"))
    links = materialize(_near(hubs.select(F.explode("as").alias("a"), F.col("id").alias("b")), sets))
    starred = materialize(components(links))
    root_of = lambda c, name: starred.select(F.col("node").alias(c), F.col("root").alias(name))
    placed = met.join(root_of("id", "r"), "id", "left").join(root_of("a", "l"), "a", "left")
    placed = materialize(placed.select("a", F.coalesce("l", "a").alias("low"), "id", F.coalesce("r", "id").alias("root")))
    # A set of another component than its hub is told by its own row; only those of their hub's are looked up by hub.
    apart, beside = placed.where("low <> root"), placed.where("low = root")
    beside = beside.join(apart.select("a").distinct(), "a", "left_semi")
    hub = apart.select(F.col("a").alias("id"), F.col("low").alias("root"))
    several = materialize(apart.select("id", "root").union(hub).union(beside.select("id", "root")).distinct())
    families = components(apart.select(F.col("low").alias("a"), F.col("root").alias("b")).distinct())
    families = families.select(F.col("node").alias("root"), F.col("root").alias("family"))
    within_families = several.join(families, "root").join(wanted.select("id", "bytes"), "id")
    more = materialize(_inside(materialize(within_families), sets, block))
    # Links between families' components are between their roots, so the links of the first pass aren't joined again.
    end = lambda c: starred.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = more.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = components(between).select(F.col("node").alias("root"), F.col("root").alias("far"))
    rooted = prints.join(starred, prints.id == starred.node, "left").select("doc_id", "th", F.coalesce("root", "id").alias("root"))
    return rooted.join(joined, "root", "left").select("doc_id", "th", F.coalesce("far", "root").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", leaders: int = LEADERS, block: int = BLOCK) -> DataFrame:
    """(doc_id, th, root), a row for each row of ``docs``; rows of a component share root."""
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("_n"), F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text")))
    found = near_numbered(rows, "_n", "_text", leaders, block)
    return found.withColumnRenamed("doc_id", "_n").join(rows.select("_n", "_id"), "_n").select(F.col("_id").alias("doc_id"), "th", "root")
