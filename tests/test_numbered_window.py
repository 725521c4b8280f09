"""Count windows over numbered streams, in several micro-batches and after restarts, against the batch window."""

import random

import pytest
from pyspark.sql import functions as F

from proxjoin.operators import approx, window
from proxjoin.sources import sinks
from proxjoin.streaming import numbered

S = ["s0", "s1", "s2"]
SCHEMA = "tupleId string, o long, streamId string, x double, y double"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def made(n: int, seed: int = 1) -> list[tuple]:
    rnd = random.Random(seed)
    out = [(f"t{i:04d}", i, f"s{rnd.randrange(4)}", rnd.uniform(0, 10), rnd.uniform(0, 10)) for i in range(n)]
    out[7] = (*out[7][:3], None, 1.0)
    return [(*r[:3], 5.0, 5.0) if i % 9 == 0 else r for i, r in enumerate(out)]


def pour(spark, rows, at):
    """A part of the stream arrives and is numbered."""
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(f"{at}/in")
    source = spark.readStream.schema(SCHEMA).parquet(f"{at}/in")
    numbered.number_rows(source, "o", f"{at}/log", f"{at}/numbering").awaitTermination()
    return numbered.numbered_stream(spark, f"{at}/log", source.schema)


def parts(log, fields=("tupleId", "x", "y", "seq", "seq_time")):
    return {s: log.where(F.col("streamId") == s).select(*fields) for s in S}


def batch_window(spark, rows, radius, length, kind="euclidean"):
    n = window.sequence(spark.createDataFrame(rows, SCHEMA), "o")
    return window.window_join({s: n.where(F.col("streamId") == s) for s in S}, ["x", "y"], radius, length, kind)


@pytest.mark.parametrize(("kind", "radius", "cuts"), [("euclidean", 3.0, [0, 90, 100, 240]), ("cosine", 0.01, [0, 240])])
def test_changes_over_batches_and_restarts(spark, tmp_path, kind, radius, cuts):
    rows, length, at = made(240), 40, str(tmp_path)
    for part in (rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)):
        log = pour(spark, part, at)
        changes = numbered.window_changes(log, parts(log), ["x", "y"], radius, length, kind)
        # Each start goes on from the checkpoint of the last.
        sinks.stream_rows(changes.select("joinId", "at", "isExpired", "s0__x", *[f"{s}__seq" for s in S]), f"{at}/rows", f"{at}/joining").awaitTermination()
    stored = spark.read.parquet(f"{at}/log/rows")
    assert sorted((r.tupleId, r.seq) for r in stored.collect()) == [(r[0], r[1] + 1) for r in rows]
    got = spark.read.parquet(f"{at}/rows")
    wide = batch_window(spark, rows, radius, length, kind)
    want = sorted(tuple(r) for r in window.changes(wide, S, len(rows), length).select("joinId", "at", "isExpired").collect())
    assert len(want) > 100 and any(r[2] for r in want)
    assert sorted(tuple(r) for r in got.select("joinId", "at", "isExpired").collect()) == want
    left = numbered.change_totals(got, "s0", ["x"]).first()
    alive = window.alive(wide, S, len(rows), length).agg(F.count("*").alias("n"), F.coalesce(F.sum("s0__x"), F.lit(0.0)).alias("x")).first()
    assert left["count"] == alive.n and left["sum"] == pytest.approx(alive.x) and left["avg"] == pytest.approx(alive.x / alive.n if alive.n else 0.0)


def test_no_task_sees_all_rows(spark, tmp_path):
    rows, at = made(600), str(tmp_path)
    log = pour(spark, rows, at)
    changes = numbered.window_changes(log, parts(log), ["x", "y"], 0.5, 200)
    running = sinks.stream_rows(changes.select("joinId", "at", "isExpired"), f"{at}/rows", f"{at}/joining")
    running.awaitTermination()
    states = [s for p in running.recentProgress for s in p["stateOperators"]]
    assert states and all(s["operatorName"] == "symmetricHashJoin" and s["numShufflePartitions"] == 3 for s in states)
    places = spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/rows").select(F.input_file_name()).distinct().count()
    assert places > 1


def test_state_is_dropped_as_rows_leave_the_window(spark, tmp_path):
    rows, at, length, kept = made(900), str(tmp_path), 30, []
    for k in range(3):
        log = pour(spark, rows[300 * k : 300 * (k + 1)], at)
        changes = numbered.window_changes(log, parts(log), ["x", "y"], 1.0, length)
        running = sinks.stream_rows(changes.select("joinId", "at", "isExpired"), f"{at}/rows", f"{at}/joining")
        running.awaitTermination()
        kept.append(sum(s["numRowsTotal"] for s in running.recentProgress[-1]["stateOperators"]))
    assert kept[2] < 1.3 * kept[0]


def test_a_batch_that_is_run_again_keeps_its_numbers(spark, tmp_path):
    rows, at = made(50), str(tmp_path)
    pour(spark, rows[:20], at)
    pour(spark, rows[20:], at)
    before = sorted((r.tupleId, r.seq) for r in spark.read.parquet(f"{at}/log/rows").collect())
    # A new checkpoint makes the source deliver all rows again as batch 0, which is complete.
    source = spark.readStream.schema(SCHEMA).parquet(f"{at}/in")
    numbered.number_rows(source, "o", f"{at}/log", f"{at}/again").awaitTermination()
    assert sorted((r.tupleId, r.seq) for r in spark.read.parquet(f"{at}/log/rows").collect()) == before


def test_long_form(spark, tmp_path):
    rows, at = made(120), str(tmp_path)
    log = pour(spark, rows, at)
    changes = numbered.window_changes(log, parts(log), ["x", "y"], 2.0, 25)
    out = numbered.change_rows(changes, S, ["tupleId", "x"], "q")
    sinks.stream_rows(out, f"{at}/rows", f"{at}/joining").awaitTermination()
    got = spark.read.parquet(f"{at}/rows").collect()
    assert {r.queryId for r in got} == {"q"} and any(r.isExpired for r in got)
    by: dict = {}
    for r in got:
        by.setdefault((r.joinId, r.at, r.isExpired), []).append(r.tupleId)
    assert all("-".join(sorted(ids)) == key[0] and len(ids) == 3 for key, ids in by.items())


def test_approximate_changes(spark, tmp_path):
    rows, length, at = made(300, 4), 80, str(tmp_path)
    for part in (rows[:120], rows[120:300]):
        log = pour(spark, part, at)
        streams = {s: df.withColumn("v", F.col("x") + F.col("y")) for s, df in parts(log).items()}
        changes = numbered.approx_changes(log, streams, ["x", "y"], 2.5, "s1", "v", length)
        sinks.stream_rows(changes, f"{at}/rows", f"{at}/counting").awaitTermination()
    got = spark.read.parquet(f"{at}/rows")
    for last in (len(rows), 200, 100):
        held = spark.createDataFrame(rows[max(0, last - length) : last], SCHEMA).withColumn("v", F.col("x") + F.col("y"))
        want = approx.estimate({s: held.where(F.col("streamId") == s) for s in S}, ["x", "y"], 2.5, "s1", "v").first()
        have = numbered.approx_totals(got.where(F.col("at") <= last)).first()
        assert want.joinCount > 0 and tuple(have) == pytest.approx(tuple(want))
