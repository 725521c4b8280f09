"""Windows over a log of numbered rows without keyed state, in several micro-batches and after restarts, against the batch window."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_numbered_window import SCHEMA, S, batch_window, made, parts, pour

import __spark_entry__ as entry
from proxjoin.operators import approx, window
from proxjoin.streaming import numbered


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def split(known):
    return parts(known, ("tupleId", "x", "y", "seq"))


@pytest.mark.parametrize(("kind", "radius", "cuts"), [("euclidean", 3.0, [0, 90, 100, 240]), ("cosine", 0.01, [0, 240])])
def test_changes_are_those_of_the_batch_window(spark, tmp_path, kind, radius, cuts):
    rows, length, at = made(240), 40, str(tmp_path)
    changes = numbered.window_change_batches(split, ["x", "y"], radius, length, kind)
    for part in (rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)):
        log = pour(spark, part, at)
        running = numbered.follow_log(log, f"{at}/log", changes, length, f"{at}/rows", f"{at}/joining")
        running.awaitTermination()
        assert not [s for p in running.recentProgress for s in p["stateOperators"]]  # the log is the state
    wide = batch_window(spark, rows, radius, length, kind)
    want = sorted(tuple(r) for r in window.changes(wide, S, len(rows), length).select("joinId", "at", "isExpired").collect())
    got = sorted(tuple(r) for r in spark.read.parquet(f"{at}/rows").select("joinId", "at", "isExpired").collect())
    assert len(want) > 100 and any(r[2] for r in want) and got == want


def test_files_of_a_batch_may_be_read_one_by_one(spark, tmp_path):
    """Micro-batches that hold numbers between those of others change nothing twice and lose nothing."""
    rows, length, at = made(240), 40, str(tmp_path)
    schema = pour(spark, rows, at).drop("seq", "seq_time").schema
    log = numbered.numbered_stream(spark, f"{at}/log", schema, 1)
    changes = numbered.window_change_batches(split, ["x", "y"], 3.0, length)
    numbered.follow_log(log, f"{at}/log", changes, length, f"{at}/rows", f"{at}/joining").awaitTermination()
    want = window.changes(batch_window(spark, rows, 3.0, length), S, len(rows), length).select("joinId", "at", "isExpired")
    got = spark.read.parquet(f"{at}/rows").select("joinId", "at", "isExpired")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_approximate_changes(spark, tmp_path):
    rows, length, at = made(300, 4), 80, str(tmp_path)
    with_v = lambda known: {s: df.withColumn("v", F.col("x") + F.col("y")) for s, df in split(known).items()}
    changes = numbered.approx_change_batches(with_v, ["x", "y"], 2.5, "s1", "v", length)
    for part in (rows[:120], rows[120:300]):
        log = pour(spark, part, at)
        numbered.follow_log(log, f"{at}/log", changes, length, f"{at}/rows", f"{at}/counting").awaitTermination()
    got = spark.read.parquet(f"{at}/rows")
    for last in (len(rows), 200, 100):
        held = spark.createDataFrame(rows[max(0, last - length) : last], SCHEMA).withColumn("v", F.col("x") + F.col("y"))
        want = approx.estimate({s: held.where(F.col("streamId") == s) for s in S}, ["x", "y"], 2.5, "s1", "v").first()
        have = numbered.approx_totals(got.where(F.col("at") <= last)).first()
        assert want.joinCount > 0 and tuple(have) == pytest.approx(tuple(want))


def test_a_log_without_rows_has_a_result(spark, tmp_path):
    at = str(tmp_path)
    log = pour(spark, [], at)
    changes = numbered.window_change_batches(split, ["x", "y"], 3.0, 40)
    numbered.follow_log(log, f"{at}/log", changes, 40, f"{at}/rows", f"{at}/joining").awaitTermination()
    assert numbered.change_totals(spark.read.parquet(f"{at}/rows"), "s0", ["x"]).first()["count"] == 0


def test_nothing_is_left_of_rows_that_left_the_window(spark, tmp_path):
    """Values that no sum takes back exactly, then rows far from one another: the window's estimates are 0."""
    met = [(f"m{i:03d}", i, S[i % 3], 1.0 + i % 7 / 10, 1.0 + i % 5 / 9) for i in range(120)]
    rows, at = met + [(f"z{i:03d}", 120 + i, S[i % 3], 100.0 * i, 50.0) for i in range(45)], str(tmp_path)
    with_v = lambda known: {s: df.withColumn("v", F.lit(1e15) / (F.col("seq") + 0.3)) for s, df in split(known).items()}
    changes = numbered.approx_change_batches(with_v, ["x", "y"], 2.5, "s1", "v", 40)
    for part in (rows[:70], rows[70:]):
        log = pour(spark, part, at)
        numbered.follow_log(log, f"{at}/log", changes, 40, f"{at}/rows", f"{at}/counting").awaitTermination()
    got = spark.read.parquet(f"{at}/rows")
    assert numbered.approx_totals(got.where("at <= 120")).first().joinSum > 1e15
    assert tuple(numbered.approx_totals(got).first()) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("count", [0, 300])
def test_an_average_of_nothing_is_that_of_sql(spark, tmp_path, count):
    """Rows too far apart for any combination, and no rows."""
    folder = str(tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT * REPLACE (event_id * 1000 AS user_id) FROM '/root/testdata/sf0.001/events.parquet' WHERE event_id < {count}")
    con.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    for name in ("stream_approx", "approx_weighted"):
        want = con.execute(entry.oracle_sql()[name]).fetchall()
        assert repr([tuple(r) for r in entry.queries()[name](spark, folder).collect()]) == repr(want)
