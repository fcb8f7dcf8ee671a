"""Streams with state against windows over a table and by hand."""

import os
import random
from datetime import datetime, timedelta

import pytest
from daybook.streaming import sessions as s
from pyspark.sql import functions as F

SF = os.environ.get("DAYBOOK_TEST_SF", "/root/testdata/sf0.001")
T = datetime(2024, 1, 1)
EVENT = "user_id long, ts timestamp, value double"


def at(minutes):
    return T + timedelta(minutes=minutes)


def run(spark, tmp_path, batches, make):
    """Batches of a stream, each in a run of its own over one checkpoint; the rows that each run tells."""
    told = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = make(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in/*"))
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
        q.trigger(availableNow=True).start().awaitTermination()
        rows = sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()))
        told.append([r for r in rows if not any(r in t for t in told)])
    assert len(rows) == sum(map(len, told))
    return told


def test_merged_by_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        times = sorted(rng.randrange(200) for _ in range(rng.randrange(1, 20)))
        runs = [[times[0]]]
        for t in times[1:]:
            runs[-1].append(t) if t - runs[-1][-1] <= 10 else runs.append([t])
        shuffled = [(t, t, 1) for t in times]
        rng.shuffle(shuffled)
        half = s.merged(shuffled[: len(times) // 2], 10)
        assert s.merged(half + shuffled[len(times) // 2 :], 10) == [(r[0], r[-1], len(r)) for r in runs]


def test_stream_of_the_table_equals_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    last = events.agg(F.max("ts")).first()[0]
    rows = [tuple(r) for r in events.orderBy("ts").collect()]
    n = len(rows) // 3
    batches = [rows[:n], rows[n : 2 * n], [*rows[2 * n :], (-1, last + timedelta(days=30), 0.0)], [(-1, last + timedelta(days=30), 0.0)]]
    told = run(spark, tmp_path, batches, lambda e: s.activity(e, "6 hours"))
    got = sorted(r for t in told for r in t if r[0] != -1)
    assert all(told[:3]) and len(got) > 100 and got == sorted(map(tuple, s.activity(events, "6 hours").collect()))


def test_sessions_of_a_stream(spark, tmp_path):
    batches = [
        [(1, at(0), 1.0), (1, at(100), 2.0), (2, at(5), None), (None, at(5), 1.0), (2, None, 1.0)],
        [(1, at(50), 4.0), (2, at(170), 1.0)],  # joins the two of owner 1, less than two hours late
        [(3, at(600), 0.0)],
        [(1, at(40), 9.0), (4, at(700), 0.0)],  # too late: dropped
    ]
    told = run(spark, tmp_path, batches, lambda e: s.sessions(e, F.sum("value").alias("total")))
    assert told == [[], [], [(1, at(0), at(160), 3, 7.0), (2, at(5), at(65), 1, None), (2, at(170), at(230), 1, 1.0)], []]


def test_owners_come_and_fall_silent(spark, tmp_path):
    batches = [
        [(1, at(0), 1.0), (1, at(10), 1.0), (2, at(0), 1.0), (None, at(1), 1.0)],
        [(2, at(200), 1.0), (1, at(195), 1.0)],
        [(1, at(400), 1.0)],
        [(3, at(900), 1.0)],
    ]
    told = run(spark, tmp_path, batches, lambda e: s.activity(e, "1 hour", "10 minutes"))
    assert told[0] == [(1, "active", at(0), 0), (2, "active", at(0), 0)]
    assert told[1] == [(1, "active", at(195), 0), (1, "silent", at(70), 2), (2, "active", at(200), 0), (2, "silent", at(60), 1)]
    assert told[2] == [(1, "active", at(400), 0), (1, "silent", at(255), 1), (2, "silent", at(260), 1)]
    assert told[3] == [(1, "silent", at(460), 1), (3, "active", at(900), 0)]


def test_a_late_event_joins_runs(spark, tmp_path):
    batches = [[(1, at(0), 1.0), (1, at(100), 1.0)], [(1, at(50), 1.0)], [(2, at(500), 1.0)]]
    told = run(spark, tmp_path, batches, lambda e: s.activity(e, "1 hour", "2 hours"))
    assert told == [[(1, "active", at(0), 0), (1, "active", at(100), 0)], [], [(1, "silent", at(160), 3), (2, "active", at(500), 0)]]


def test_a_gap_of_exactly_an_hour_joins(spark, tmp_path):
    rows = [(1, at(0), 1.0), (1, at(60), 1.0), (1, at(120) + timedelta(microseconds=1), 1.0)]
    assert sorted(r.n for r in s.sessions(spark.createDataFrame(rows, EVENT)).collect()) == [1, 2]
    told = run(spark, tmp_path, [rows, [(2, at(900), 1.0)]], lambda e: s.activity(e, "1 hour"))
    assert [r[3] for r in told[1] if r[1] == "silent"] == [2, 1]


def test_repeats_within_the_watermark(spark, tmp_path):
    batches = [[(1, at(0), 1.0), (1, at(1), 2.0), (2, at(2), 1.0)], [(1, at(3), 1.0)], [(3, at(500), 1.0)], [(2, at(501), 1.0)]]
    told = run(spark, tmp_path, batches, lambda e: s.once(e, ["user_id"], "30 minutes"))
    assert [[r[0] for r in t] for t in told] == [[1, 2], [], [3], [2]]


@pytest.mark.parametrize("rows", [[], [(None, at(0), 1.0)], [(1, None, 1.0)]])
def test_nothing_to_tell(spark, rows):
    events = spark.createDataFrame(rows, EVENT)
    assert s.sessions(events).count() == 0 and s.activity(events).count() == 0
