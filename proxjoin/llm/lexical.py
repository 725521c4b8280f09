"""Ranked lexical search by variable-block-max WAND, exactly.

1. Documents become shards where they lie: each task counts terms and writes rows of up to ``TOKENS`` tokens' postings
   (term, document, occurrences), in order of terms and ids. N, L and document frequencies are sums over shards.
2. With N and L known, a posting's impact is known up to its term's weight. Each posting list is cut into blocks of up to
   ``WIDTH`` postings by dynamic programming: the cut has the least total of what blocks' maxima overstate their postings'
   impacts by, plus ``BLOCK_COST`` for each block. All lists of a shard go through the recurrence together, a posting a
   step. The cut shard, with a maximum for each block, is a row of the stored index.
3. Blocks of items meet every shard. For an item, the blocks of its terms give each document of the shard an upper bound: the
   sum of maxima of the blocks that span it. Documents with the largest bounds are scored first. Then a pivot goes along
   the ids to the next documents whose bound reaches the k-th best score so far, and only blocks that span such documents
   are read. Scores are whole numbers, so bounds are exact, and a document that is passed over can't be among the k.
4. Shards' best are ranked again for each item.

Defined results: a null text, of a document or an item, has no terms; documents without terms are no documents here, and
items without terms, or whose terms no document holds, get no rows. Very long texts are a shard of their own. Repeated
documents are ranked each; documents without an id are ranked after others of their score. Repeated rows of an item (same
id and text) count once; different texts of one id are items of their own. Other columns aren't read. Empty tables give
no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxjoin.llm.common import materialize

#: Tokens of a shard, unless one document has more.
TOKENS = 1 << 20
#: Postings of a block at most, and what a block costs in units of impact.
WIDTH, BLOCK_COST = 64, 1_000_000
#: Shards of an Arrow batch.
SHARDS = 2
#: Items of a block, and documents that are scored at a time.
ITEMS, CHUNK = 1024, 512
# A-Z become a-z; bytes that stand for no term's character become spaces. In UTF-8 all other characters are bytes from 128 on.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(PLAIN).split()


def _postings(docs: list[tuple[int | None, list[bytes]]], number: int) -> dict:
    """A shard: documents in order of id, terms with the ends of their postings, postings as (document, occurrences)."""
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    lengths = np.array([len(t) for _, t in docs])
    names: defaultdict[bytes, int] = defaultdict(count().__next__)
    term = np.fromiter((names[t] for _, some in docs for t in some), np.int64, int(lengths.sum()))
    keys, tf = np.unique(term * len(docs) + np.repeat(np.arange(len(docs)), lengths), return_counts=True)
    held = np.bincount(keys // len(docs), minlength=len(names))
    return {
        "shard": [number], "doc_ids": [[i for i, _ in docs]], "lengths": [lengths.tolist()], "terms": [[t.decode() for t in names]], "held": [held.tolist()],
        "docs": [(keys % len(docs)).astype(np.int32).tobytes()], "tf": [tf.astype(np.int64).tobytes()],
    }


SHARD = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("held", pa.list_(pa.int64())), ("docs", pa.binary()), ("tf", pa.binary())])


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple] = []
        tokens, number = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if some := terms_of(raw.as_py()):
                    if held and tokens + len(some) > TOKENS:
                        yield pa.RecordBatch.from_pydict(_postings(held, number), schema=SHARD)
                        held, tokens, number = [], 0, number + 1
                    held.append((doc_id, some))
                    tokens += len(some)
        if held:
            yield pa.RecordBatch.from_pydict(_postings(held, number), schema=SHARD)

    rows = docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "shard long, doc_ids array<long>, lengths array<long>, terms array<string>, held array<long>, docs binary, tf binary")


def best_blocks(impact: np.ndarray, held: np.ndarray, width: int = WIDTH, cost: int = BLOCK_COST) -> np.ndarray:
    """Ends of the blocks of consecutive lists of ``held`` postings, in order of postings.

    f(i), the least cost of a list's first i postings, is the least over j of f(j) + (i - j) * max(impact[j:i]) + cost; the
    sum of impacts is the same for all cuts. Row j % width of the tables belongs to j, a column to each list.
    """
    starts = np.cumsum(held) - held
    chosen = np.ones(len(impact), np.int64)
    longer = np.flatnonzero(held > 1)
    order = longer[np.argsort(-held[longer], kind="stable")]
    first, long = starts[order], held[order]
    width = max(1, min(width, int(long.max(initial=1))))
    most, f = np.zeros((width, len(order)), np.int64), np.zeros((width, len(order)), np.int64)
    for i in range(1, int(long.max(initial=0)) + 1):
        n = int(np.searchsorted(-long, -i, side="right"))  # lists with i postings or more
        w = min(i, width)
        s = impact[first[:n] + i - 1]
        m = most[:w, :n]
        np.maximum(m, s, out=m)
        most[(i - 1) % width, :n] = s
        rows = np.arange(w)
        back = (i - 1 - rows) % width + 1  # i - j for row j % width
        if i < width:
            back = i - rows
        total = m * back[:, None] + f[:w, :n]
        best = total.argmin(axis=0)
        chosen[first[:n] + i - 1] = back[best]
        f[i % width, :n] = total[best, np.arange(n)] + cost
    ends = np.zeros(len(impact), bool)
    at = (starts + held)[held > 0]
    begin = starts[held > 0]
    while len(at):
        ends[at - 1] = True
        at = at - chosen[at - 1]
        more = at > begin
        at, begin = at[more], begin[more]
    return np.flatnonzero(ends) + 1


INDEX = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("blocks", pa.binary()), ("ends", pa.binary()), ("most", pa.binary()), ("docs", pa.binary()), ("impact", pa.binary())])


def index(stored: DataFrame, documents: int, tokens: int) -> DataFrame:
    """Shards with impacts, cut into blocks: ``blocks`` says how many of them a term has, ``ends`` and ``most`` describe them."""

    def cut(row: dict) -> dict:
        m = 100 - 50 + (50 * np.array(row["lengths"], np.int64) * documents) // tokens
        docs, tf = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tf"], np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[docs])
        held = np.array(row["held"], np.int64)
        ends = best_blocks(impact, held)
        blocks = np.diff(np.searchsorted(ends, np.cumsum(held), side="right"), prepend=0)
        most = np.maximum.reduceat(impact, np.r_[0, ends[:-1]])
        return {
            "shard": [row["shard"]], "doc_ids": [row["doc_ids"]], "terms": [row["terms"]], "blocks": [blocks.astype(np.int32).tobytes()], "ends": [ends.astype(np.int32).tobytes()],
            "most": [most.astype(np.int32).tobytes()], "docs": [row["docs"]], "impact": [impact.astype(np.int32).tobytes()],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield pa.RecordBatch.from_pydict(cut(batch.slice(k, 1).to_pylist()[0]), schema=INDEX)

    return stored.mapInArrow(run, "shard long, doc_ids array<long>, terms array<string>, blocks binary, ends binary, most binary, docs binary, impact binary")


class Shard:
    """A shard of the index, ready to be searched."""

    def __init__(self, row: dict):
        self.number = {t: i for i, t in enumerate(row["terms"])}
        self.docs, self.impact = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["impact"], np.int32)
        self.ends, self.most = np.frombuffer(row["ends"], np.int32).astype(np.int64), np.frombuffer(row["most"], np.int32).astype(np.int64)
        self.starts = np.r_[0, self.ends[:-1]]
        self.low, self.high = self.docs[self.starts], self.docs[self.ends - 1]
        last = np.cumsum(np.frombuffer(row["blocks"], np.int32).astype(np.int64))
        self.term_low, self.term_high = np.r_[0, last[:-1]], last
        self.size = len(row["doc_ids"])
        self.read = 0  # postings read so far

    def search(self, terms: list[str], weights: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the ``k`` best documents, and their scores above 0."""
        known = [(self.number[t], w) for t, w in zip(terms, weights, strict=True) if w > 0 and t in self.number]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        block = np.concatenate([np.arange(self.term_low[t], self.term_high[t]) for t, _ in known])
        weight = np.repeat([w for _, w in known], [self.term_high[t] - self.term_low[t] for t, _ in known])
        steps = np.zeros(self.size + 1, np.int64)
        np.add.at(steps, self.low[block], weight * self.most[block])
        np.add.at(steps, self.high[block] + 1, -weight * self.most[block])
        bound = np.cumsum(steps[:-1])
        seeds = np.argpartition(-bound, min(2 * k, self.size - 1))[: 2 * k]
        seeds = np.sort(seeds[bound[seeds] > 0])
        found, scores = self._best(seeds, self._scores(seeds, block, weight), k)
        bound[seeds] = 0
        pivot = 0
        while pivot < self.size:
            least = scores[-1] if len(scores) == k else 1
            after = np.flatnonzero(bound[pivot:] >= least)[:CHUNK] + pivot
            if not len(after):
                break
            found, scores = self._best(np.r_[found, after], np.r_[scores, self._scores(after, block, weight)], k)
            pivot = int(after[-1]) + 1
        return found, scores

    @staticmethod
    def _best(found: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Larger scores first, then smaller ids, which are in order of places."""
        order = np.lexsort((found, -scores))[:k]
        order = order[scores[order] > 0]
        return found[order], scores[order]

    def _scores(self, places: np.ndarray, block: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of some documents, from the blocks that span one of them."""
        at = np.full(self.size, -1)
        at[places] = np.arange(len(places))
        upto = np.r_[0, np.cumsum(at >= 0)]
        some = upto[self.high[block] + 1] > upto[self.low[block]]
        block, weight = block[some], weight[some]
        many = self.ends[block] - self.starts[block]
        self.read += int(many.sum())
        posting = np.repeat(self.starts[block] - np.cumsum(many) + many, many) + np.arange(many.sum())
        to = at[self.docs[posting]]
        hit = to >= 0
        total = np.zeros(len(places), np.int64)
        np.add.at(total, to[hit], (np.repeat(weight, many) * self.impact[posting])[hit])
        return total


def asked(items: DataFrame, stored: DataFrame, documents: int, key: str, text: str) -> DataFrame:
    """(block, items): blocks of items, each with its own number, id, and the terms that documents hold with their weights."""
    own = materialize(items.select(F.col(key).alias("id"), F.col(text).alias("t")).distinct().withColumn("item", F.monotonically_increasing_id()))
    kind = own.schema["id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[t.decode() for t in sorted(set(terms_of(v)))] for v in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("id"), pa.array(parts, pa.list_(pa.string()))], ["item", "id", "terms"])

    rows = materialize(own.mapInArrow(split, f"item long, id {kind}, terms array<string>").select("item", "id", F.explode("terms").alias("term")))
    frequencies = stored.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("held").alias("held"))))
    frequencies = frequencies.join(rows.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("held").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * F.lit(documents) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = rows.join(frequencies.select("term", weight.alias("w")), "term")
    ready = weighed.groupBy("item", "id").agg(F.collect_list(F.struct("term", "w")).alias("terms"))  # an item's own terms
    places = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_part = ready.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(4096)))
    sizes = by_part.groupBy("block").count().select("block", F.coalesce(F.sum("count").over(places), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("block").orderBy("item"))
    numbered = by_part.join(sizes, "block").withColumn("block", F.floor((F.col("before") + nth - 1) / ITEMS))
    return numbered.groupBy("block").agg(F.collect_list(F.struct("item", "id", "terms")).alias("items"))


def search(indexed: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(item, id, doc_id, score): every shard's ``k`` best for every item. Blocks of items meet all shards."""
    kind = blocks.schema["items"].dataType.elementType["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard, ids = None, None, None
        for batch in batches:
            for n in range(len(batch)):
                row = batch.slice(n, 1)
                if row.column("shard")[0].as_py() != last:
                    last = row.column("shard")[0].as_py()
                    shard, ids = Shard({c: row.column(c)[0].as_py() for c in ("doc_ids", "terms", "docs", "impact", "ends", "most", "blocks")}), row.column("doc_ids").flatten()
                items, ids_of, docs, scores = [], [], [], []
                for item in row.column("items")[0].as_py():
                    found, score = shard.search([t["term"] for t in item["terms"]], [t["w"] for t in item["terms"]], k)
                    items += [item["item"]] * len(found)
                    ids_of += [item["id"]] * len(found)
                    docs.append(found)
                    scores.append(score)
                at = pa.array(np.concatenate(docs).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(ids_of, batch.schema.field("items").type.value_type.field("id").type), ids.take(at), pa.array(np.concatenate(scores))], ["item", "id", "doc_id", "score"])

    # A stated query set against all rows, in blocks: Spark sends the blocks to the shards if they are small, and pairs
    # partitions of both otherwise.
    return indexed.crossJoin(blocks.select("items")).mapInArrow(run, f"item long, id {kind}, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of the highest scores above 0."""
    stored = materialize(shards(docs, key, text), large_rows=True)
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda t, n: t + n)
    documents, tokens = stored.agg(F.coalesce(F.sum(F.size("lengths")), F.lit(0)), F.coalesce(F.sum(total), F.lit(0))).first()
    indexed = materialize(index(stored, documents, max(1, tokens)), large_rows=True, batch=SHARDS)
    blocks = materialize(asked(items, stored, documents, item, item_text))
    found = materialize(search(indexed, blocks, k), batch=SHARDS)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(item), "rank", F.col("doc_id").alias(key), "score")
