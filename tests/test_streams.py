"""Streams that end their state: rolling duplicates in any order, and sessions with late events."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cuewright.operators import cues
from cuewright.streaming import cues as stream

EVENTS = "user_id long, ts timestamp, value double"


def as_batches(spark, folder, batches, schema):
    """A stream of files, one for each micro-batch, in order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, base):
    query = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/at").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return query


def test_cues_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    words = "the bridge ﬁne Ｆｕｌｌ steel winter [Music] river".split()
    rows = []
    for v in ("a", "b", "c"):
        last = []
        for i in range(20):
            text = last[-3:] + [rng.choice(words) for _ in range(rng.randrange(0, 5))] if i % 2 else [rng.choice(words) for _ in range(rng.randrange(0, 5))]
            rows.append((v, i, float(i), i + 1.0, " ".join(text)))
            last = text or last
    want = [tuple(r) for r in cues.clean_transcript(spark.createDataFrame(rows, cues.CUES)).orderBy("video_id", "idx").collect()]
    rng.shuffle(rows)
    arriving = as_batches(spark, f"{tmp_path}/in", [rows[i::4] for i in range(4)], cues.CUES)
    with pytest.raises(ValueError, match="RocksDB"):
        stream.drop_rolling_stream(arriving)
    with stream.rocksdb(spark, ends=True):
        run(stream.drop_rolling_stream(arriving), tmp_path)
    got = [tuple(r) for r in spark.read.schema(cues.CUES).parquet(f"{tmp_path}/out").orderBy("video_id", "idx").collect()]
    assert got == want and any("fine" in r[4] or "Full" in r[4] for r in got)


def test_missing_cues_are_given_up_and_idle_videos_forgotten(spark, tmp_path):
    row = lambda v, i, t: (v, i, float(i), i + 1.0, t)
    spark.createDataFrame([row("a", 0, "one"), row("a", 2, "three")], cues.CUES).coalesce(1).write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(cues.CUES).parquet(f"{tmp_path}/in")
    with stream.rocksdb(spark):
        query = stream.drop_rolling_stream(arriving, wait_s=1.0, idle_s=1.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").start()
    try:
        until = time.monotonic() + 60
        rows = []
        while time.monotonic() < until and (len(rows) < 2 or query.lastProgress["stateOperators"][0]["numRowsTotal"]):
            time.sleep(0.5)
            rows = [(r.idx, r.text) for r in spark.read.schema(cues.CUES).parquet(f"{tmp_path}/out").orderBy("idx").collect()]
        assert rows == [(0, "one"), (1, "three")]
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    finally:
        query.stop()


def test_sessions_merge_and_late_events_are_counted(spark, tmp_path):
    at = lambda m: f"2024-01-01 {10 + m // 60:02d}:{m % 60:02d}:00"
    first = [(1, at(0), 1.0), (1, at(50), 1.0), (2, at(10), 1.0)]
    second = [(1, at(25), 1.0)]  # lies between two sessions and makes them one
    third = [(3, at(300), 1.0)]  # moves the watermark on
    fourth = [(3, at(301), 1.0)]  # what is late is told by the watermark of the batch before
    fifth = [(1, at(20), 9.0), (2, at(11), 9.0)]  # both come too late
    sixth = [(4, at(700), 1.0)]
    text = "user_id long, ts string, value double"
    for rows in (first, second, third, fourth, fifth, sixth):
        spark.createDataFrame(rows, text).select("user_id", F.to_timestamp("ts").alias("ts"), "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    late = stream.LateRows()
    spark.streams.addListener(late)
    try:
        run(stream.sessions(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")), tmp_path)
        until = time.monotonic() + 10
        while late.n < 2 and time.monotonic() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(late)
    got = {(r.user_id, r.session_start.strftime("%H:%M"), r.session_end.strftime("%H:%M"), r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, "10:00", "10:50", 3), (2, "10:10", "10:10", 1), (3, "15:00", "15:01", 2)}
    assert late.n == 2
