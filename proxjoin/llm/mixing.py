"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in a hashed order and laid end to end; blocks of ``block`` words cut that line. The
mix is a walk along golden-ratio points: a point falls into one source's share of the unit line (shares are cumulative
weights, in blocks), and its rank among the points of that source says which block stands in that slot, round and
round. The walk goes on until the points have given every source the words of its target; a source that has them takes
no further slot. So the points decide where each block stands, every stretch of the mix is close to the weights, and a
source that the points don't reach gets nothing. Documents are taken in whole rounds, the last round in part.

Defined results: a null text has size 0; the null source is a source of its own, after all others; documents of size
0 are returned with nothing taken and no slot. Repeated rows are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxjoin.llm.common import hash_bucket, materialize, parcel, prefix_sums, union_all, unparcel, word_count, words_of

WEIGHTS = (5, 2, 1)
#: The golden ratio's fraction, and that of its product with 2 ** 20.
GOLDEN, GOLDEN_20 = 0.6180339887498949, 0.8085724711418152
CELLS = 1024
#: Words of a block: about a document's, so that the walk has about as many slots as there are documents.
BLOCK = 256
#: Slots of a stretch, as a power of two.
STRETCH = 10
#: A walk of so many times the mix's slots has met every share of a slot or more.
WALKS = 8


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Add weight and target to (no_source, source_key, source_size). No target is above ``most`` times its source's size.

    In order of size by weight, a source is held at its limit if an even share of what is left would be above it.
    The table has a row for each source.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy("no_source", "source_key")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sources.withColumn("weight", w.cast("long"))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "no_source", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    left = F.sum("source_size").over(every) - most * earlier("source_size")
    share = F.sum("weight").over(every) - earlier("weight")
    out = out.withColumn("_held", left * F.col("weight") > most * F.col("source_size") * share)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("_held"), most * F.col("source_size"))).over(every), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_held"), F.col("weight"))).over(every)
    out = out.withColumn("target", F.when(F.col("_held"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * rest.cast("double") / open_weight))
    return out.drop("_held")


def _golden(i: Column) -> Column:
    high, low = F.shiftright(i, 20), F.pmod(i, F.lit(1 << 20))
    return F.pmod(F.pmod(high * F.lit(GOLDEN_20), F.lit(1.0)) + low * F.lit(GOLDEN), F.lit(1.0))


def _points(first: int, end: int, shares: DataFrame) -> DataFrame:
    """The points from ``first`` on, before ``end``, with the source that each falls to."""
    spark = shares.sparkSession
    points = spark.range(first, end).select("id", _golden(F.col("id") + 1).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    # A row for each source, and for each cell that a share meets: as many as sources and cells.
    return points.join(shares, "cell").where("u >= low AND u < high").select("no_source", "source_key", F.col("id").alias("slot"))


def schedule(plan: DataFrame) -> DataFrame:
    """Slots (no_source, source_key, slot, rank) of the mix: as many for each source as ``slots`` says.

    ``slot`` is the place in the walk, ``rank`` counts a source's slots. The walk is as long as the mix has slots, and
    goes on while points still lack for some source: by about two for each that lacks, over its share. A share of p is
    met once in about 1.9 / p points at least, so the walk ends; should points never meet a share, it gets no slot.
    """
    n = plan.agg(F.sum("slots")).first()[0] or 0
    before = Window.orderBy("no_source", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum("slots").over(before), F.lit(0)) / F.lit(max(n, 1))
    plan = plan.where("slots > 0").select("no_source", "source_key", "slots", low.alias("low"), (low + F.col("slots") / F.lit(max(n, 1))).alias("high"))
    shares = plan.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    shares = materialize(shares)
    parts, end, more = [], 0, n
    while True:
        parts.append(materialize(_points(end, end + more, shares)))
        end += more
        had = union_all(parts).groupBy("no_source", "source_key").agg(F.count("*").alias("had"))
        lacking = plan.join(had, ["no_source", "source_key"], "left").withColumn("lack", F.col("slots") - F.coalesce("had", F.lit(0))).where("lack > 0")
        further = lacking.agg(F.max(F.ceil((F.col("lack") + 2) * F.lit(float(n)) / F.col("slots")))).first()[0]
        if further is None:
            break
        if end > WALKS * n + 4096:
            raise RuntimeError(f"{end} points left a source of {n} slots without its words: they aren't evenly spread")
        more = int(further)
    hit = union_all(parts).join(plan.select("no_source", "source_key", "slots"), ["no_source", "source_key"]).withColumn("run", F.shiftright("slot", 13))
    ranked = prefix_sums(hit, ["no_source", "source_key"], "run", ["slot"], {"rank": F.lit(1)})
    return ranked.where("rank < slots").select("no_source", "source_key", "slot", "rank")


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", block: int = BLOCK, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_slot (the walk's slot of its first block).

    ``at`` has the slot of each of its rounds, and ``start`` its place in its source; ``keep`` names further columns to
    carry along.
    """
    keep = keep or []
    # The text's hash is in the order too, so that rows without an id are spread.
    sizes = materialize(docs.select(
        F.col(key).alias("doc_id"), F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source), F.lit("")).alias("source_key"),
        word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(2024), F.col(key), F.col(text)).alias("_h"), *[F.col(c).alias(f"_keep_{c}") for c in keep],
    ))
    place = ["no_source", "source_key"]
    plan = targets(sizes.groupBy(*place).agg(F.sum("size").alias("source_size")))
    plan = plan.withColumn("take", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    some = F.col("source_size") > 0
    plan = plan.withColumn("rounds", F.when(some, F.floor(F.col("take") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("take") - F.col("rounds") * F.col("source_size"))
    plan = materialize(plan.withColumn("slots", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / F.lit(block)).cast("long")))

    slots = schedule(plan.select(*place, "slots")).join(plan.select(*place, "blocks", "rounds", "rest"), place)
    whole = F.col("rank") < F.col("rounds") * F.col("blocks")
    slots = slots.select(*place, F.pmod("rank", "blocks").alias("block_no"), whole.alias("whole"), "rest", "slot")
    taken = slots.groupBy(*place, "block_no").agg(
        F.sum(F.col("whole").cast("long")).alias("times"),
        F.max(F.when(~F.col("whole"), F.least(F.lit(block), F.col("rest") - F.col("block_no") * block))).alias("part"),
        F.sort_array(F.collect_list("slot")).alias("slots"),  # one for each round: three and a part at most
    )

    laid = prefix_sums(sizes.withColumn("_bucket", hash_bucket(F.col("_h"))), place, "_bucket", ["_h", "doc_id", "size"], {"start": F.col("size"), "row": F.lit(1)})
    end = F.col("start") + F.col("size")
    cut = laid.withColumn("block_no", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / F.lit(block)), F.floor((end - 1) / F.lit(block))))))
    cut = cut.join(taken, [*place, "block_no"], "left")
    since = F.greatest(F.col("start"), F.col("block_no") * block)
    whole_words = F.least(end, (F.col("block_no") + 1) * block) - since
    # least() passes over nulls, so a block without a cut slot is told apart first.
    part_words = F.when(F.col("part").isNotNull(), F.greatest(F.lit(0), F.least(end, F.col("block_no") * block + F.col("part")) - since))
    out = cut.groupBy(*place, "row", "doc_id", "size", "start", *[f"_keep_{c}" for c in keep]).agg(
        F.coalesce(F.sum(F.coalesce("times", F.lit(0)) * whole_words + F.coalesce(part_words, F.lit(0))), F.lit(0)).cast("long").alias("taken"),
        F.min_by("slots", "block_no").alias("at"),
    )
    out = out.join(plan.select(*place, "source_size", "target"), place)
    first = F.when(F.col("taken") > 0, F.get("at", F.lit(0))).alias("first_slot")
    return out.select("doc_id", "size", "source_size", "target", "taken", first, "at", "start", *[F.col(f"_keep_{c}").alias(c) for c in keep])


def mixed(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", size: str | None = "n_chars", block: int = BLOCK) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as many times as it is taken whole, and the words of
    the last round where it is cut (one document of a source at most; its words are then joined by single spaces).

    Each copy stands at its slot: a partition holds whole stretches of the walk, in order.
    """
    # Stored with a number for each row, so that numbers alone go through the plan.
    rows = materialize(parcel(docs, text).select("_row", "_text", F.monotonically_increasing_id().alias("_n")))
    taken = mix(rows.select("_n", F.col("_row").getField(key).alias("_key"), F.col("_row").getField(source).alias("_source"), "_text"), "_source", "_text", "_key", block, ["_n"])
    taken = taken.where("taken > 0").select("_n", "size", "taken", "at", "start")
    rest = F.pmod("taken", "size")
    part = F.when(rest > 0, F.array(F.array_join(F.slice(words_of(F.col("_text")), 1, rest.cast("int")), " "))).otherwise(F.expr("CAST(array() AS array<string>)"))
    copies = F.concat(F.array_repeat(F.col("_text"), F.floor(F.col("taken") / F.col("size")).cast("int")), part)
    out = rows.join(taken, "_n").select("_row", "at", "start", F.posexplode(copies).alias("_k", "_text"))
    out = out.select("_row", "_text", F.get("at", F.col("_k")).alias("_slot"), "start", "_k")
    out = out.repartition(F.shiftright("_slot", STRETCH)).sortWithinPartitions("_slot", "start", "_k")
    return unparcel(out, docs, text, size)
