"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (one and two words) are counted: of the raw corpus (every document) and
of the target (documents labelled good and not toxic). A document's log importance weight is the sum over its n-grams
of log p(target) - log p(raw); adding Gumbel noise drawn from a hash of its id and taking the top k samples documents
without replacement in proportion to their weights. k is the corpus's size times the target's share of the labelled.

Defined results: a null or empty text has no n-grams and weight 0. Labels may repeat (a document is good if all its
labels say so), be null (then they say nothing) or name unknown documents. Without target documents all weights are 0,
and all are kept. Rows with repeated ids are scored each. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxjoin.llm.common import materialize, prefix_sums, small_batches

#: Numbers that n-grams are hashed to; it bounds the models.
BUCKETS = 1 << 16
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 17)
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_MULTIPLIER, np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64)))]
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ngrams(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed numbers of a text's words and word pairs, with A-Z in lower case."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    blank = np.r_[True, _space[raw], True]
    start = np.flatnonzero(blank[:-1] & ~blank[1:])
    if not len(start):
        return np.zeros(0, np.int64)
    end = np.flatnonzero(~blank[:-1] & blank[1:])
    power, inverse = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    word = _mix((sums[end] - sums[start]) * inverse[start])
    pair = _mix(word[:-1] * np.uint64(3) + word[1:])
    return (np.concatenate([word, pair]) % np.uint64(buckets)).astype(np.int64)


def counts(docs: DataFrame, labels: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """(bucket, raw, target): n-grams of all documents and of the target's, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for x, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist(), strict=True):
                found = ngrams(x, buckets)
                np.add.at(raw, found, 1)
                if good:
                    np.add.at(target, found, 1)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    joined = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(labels, F.col("_key") == labels["_id"], "left").select("text", "good")
    small_batches(docs.sparkSession)
    return joined.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def weights(counted: list[tuple[int, int, int]], buckets: int, smoothing: float = 0.5) -> np.ndarray:
    """log p(target) - log p(raw) of each n-gram number; 0 where there is no target."""
    raw, target = np.full(buckets, smoothing), np.full(buckets, smoothing)
    for b, r, t in counted:
        raw[b] += r
        target[b] += t
    if not any(t for _, _, t in counted):
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, seed: int = 5) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, kept)."""
    spark = docs.sparkSession
    small_batches(spark)
    good = (F.min(F.when((F.col("quality") > 0) & (F.col("toxic") == 0), 1).otherwise(0)) == 1).alias("good")
    known = materialize(labels.where("quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(good))
    n_good, n_known = known.agg(F.coalesce(F.sum(F.col("good").cast("int")), F.lit(0)), F.count("*")).first()
    counted = counts(docs, known, key, text, buckets).collect()  # a row for each number at most
    sent = spark.sparkContext.broadcast(weights([tuple(r) for r in counted], buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            found = [ngrams(x, buckets) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(f) for f in found], pa.int64()), pa.array([float(math.fsum(w[f])) for f in found], pa.float64())], ["doc_id", "n_grams", "log_weight"])

    scored = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_grams long, log_weight double")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    scored = materialize(scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))))
    total = scored.count()
    k = round(total * n_good / n_known) if n_good else total
    # Ranked in two passes over ranges of keys, whose bounds are the corpus's own quantiles.
    cuts = scored.agg(F.percentile_approx("gumbel_key", F.array(*[F.lit(i / 256) for i in range(1, 256)]), F.lit(10000))).first()[0] or []
    above = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(cuts))]), lambda c: c > F.col("gumbel_key"))) if cuts else F.lit(0)
    ranked = prefix_sums(scored.withColumn("b", above), [], "b", [F.desc("gumbel_key"), "doc_id"], {"nth": F.lit(1)})
    return ranked.select("doc_id", "n_grams", "log_weight", "gumbel_key", (F.col("nth") < F.lit(k)).alias("kept"))
