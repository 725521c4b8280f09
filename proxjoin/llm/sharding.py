"""Balanced label propagation: documents move towards the shards of the documents they are linked with.

Documents with equal texts are linked. All start in the shard their id's hash names. In each round a group's members
vote with their numbers: shards where a group is strongest receive, and its members elsewhere ask to move there. A
shard grants requests, in a hashed order, as far as its quota goes. Since equal documents of a group in one shard vote
alike, rounds work on (group, shard) counts, never on all documents of a group in one place; a group too large for one
shard has as many receiving shards as it fills. At the end, what is above a shard's quota (documents without links
first) fills the shards below theirs, so counts are at most one apart.

Defined results: a null text has no bytes; null texts are equal to each other, and not to the empty text. Repeated rows
are placed each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxjoin.llm.common import hash_bucket, materialize, prefix_sums

ROUNDS = 6


def _of(numbers: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in numbers]), (index + 1).cast("int"))


def _by_shard(counted: DataFrame, shards: int) -> list[int]:
    """The driver holds one number for each shard."""
    out = [0] * shards
    for row in counted.collect():
        out[row[0]] = row[1]
    return out


def propagate(cells: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(g, home, n, shard): where the ``n`` members of group ``g`` that began in ``home`` go."""
    shards, least = len(quota), max(1, min(quota))
    cells = materialize(cells.withColumn("shard", F.col("home")))
    for turn in range(rounds):
        held = cells.groupBy("g", "shard").agg(F.sum("n").alias("m"))
        load = _by_shard(cells.groupBy("shard").agg(F.sum("n")), shards)
        # A group is in as many shards as there are, at most.
        full = _of([int(x > q) for x, q in zip(load, quota, strict=True)], F.col("shard"))
        strong = Window.partitionBy("g").orderBy(full, F.desc("m"), F.xxhash64("g", "shard"), "shard")
        every = Window.partitionBy("g")
        ranked = held.withColumn("rk", F.row_number().over(strong)).withColumn("need", F.ceil(F.sum("m").over(every) / least).cast("int"))
        ranked = ranked.withColumn("order", F.array_sort(F.collect_list(F.struct("rk", "shard")).over(every)))
        asks = ranked.where("rk > need").withColumn("to", F.get("order", F.pmod(F.col("rk") - 1, F.col("need")))["shard"])
        asks = materialize(asks.select("g", "shard", "to", "m", F.xxhash64(F.lit(turn), "g", "shard").alias("h")).where("to <> shard"))
        leaving = _by_shard(asks.groupBy("shard").agg(F.sum("m")), shards)
        room = [q - x + y for q, x, y in zip(quota, load, leaving, strict=True)]
        ran = prefix_sums(asks.withColumn("b", hash_bucket(F.col("h"))), ["to"], "b", ["h", "g", "shard"], {"before": F.col("m")})
        granted = ran.where(F.col("before") + F.col("m") <= _of(room, F.col("to"))).select("g", "shard", "to")
        before = cells
        cells = materialize(before.join(granted, ["g", "shard"], "left").select("g", "home", "n", F.coalesce("to", "shard").alias("shard"), F.col("to").isNotNull().alias("moved")))
        if not cells.where("moved").limit(1).count():
            break
        cells = cells.drop("moved")
    return cells.select("g", "home", "n", "shard")


def assign(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard); law is ``rows``: counts are at most one apart."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    bytes_ = F.octet_length(raw).cast("long")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (bytes_ + 16).alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw, F.col(text).isNull()).alias("x"), F.xxhash64(F.lit(11), key).alias("h"))
    # The group's name holds two hashes and the size of the text.
    rows = materialize(rows.select("doc_id", "size", "text_crc32", "h", F.struct("x", "text_crc32", "size").alias("g"), F.pmod("h", F.lit(shards)).cast("int").alias("home")))
    counts = materialize(rows.groupBy("g", "home").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    linked = counts.groupBy("g").agg(F.sum("n").alias("all")).where("all > 1").select("g")
    cells = propagate(counts.join(linked, "g"), quota).select("g", "home", F.col("shard").alias("label"))
    placed = materialize(rows.join(cells, ["g", "home"], "left").select("doc_id", "size", "text_crc32", "h", F.coalesce("label", "home").alias("label"), F.col("label").isNull().cast("int").alias("single")))
    have = _by_shard(placed.groupBy("label").agg(F.count("*")), shards)
    # Those with links come first, so that others go where a shard holds too many.
    bucket = F.shiftleft("single", 11) + hash_bucket(F.col("h"), 11)
    ranked = prefix_sums(placed.withColumn("b", bucket), ["label"], "b", ["h", "doc_id"], {"slot": F.lit(1)})
    ranked = materialize(ranked.withColumn("stays", F.col("slot") < _of(quota, F.col("label"))))
    stay = ranked.where("stays").select("doc_id", "size", "text_crc32", F.col("label").alias("shard"), "slot")
    gaps = [max(0, q - x) for q, x in zip(quota, have, strict=True)]
    below = [sum(gaps[:s]) for s in range(shards)]
    spare = prefix_sums(ranked.where("NOT stays").withColumn("b", hash_bucket(F.col("h"))), [], "b", ["h", "doc_id", "label", "slot"], {"nth": F.lit(1)})
    shard = sum(((F.col("nth") >= F.lit(sum(gaps[: s + 1]))).cast("int") for s in range(shards - 1)), F.lit(0))
    spare = spare.withColumn("shard", shard).withColumn("slot", _of(have, F.col("shard")) + F.col("nth") - _of(below, F.col("shard")))
    out = stay.unionByName(spare.select("doc_id", "size", "text_crc32", "shard", "slot"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
