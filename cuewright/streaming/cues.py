"""Cues that arrive as a stream, and jobs that run once each whatever breaks off."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.text import clean_text
from ..operators.cues import CUES, new_words
from ..shipping import ship


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds that a cue waits for one before it, and after which a video without new cues is forgotten.
WAIT_S, IDLE_S = 60.0, 3600.0


@contextmanager
def rocksdb(spark: SparkSession, ends: bool = False) -> Iterator[None]:
    """The state store that transformWithState needs, for queries that start inside.

    ends: they run on what is there and end. Spark would go on with empty batches for ever then, as a timer may be due
    some time; without these, timers are looked at as data come.
    """
    names = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, **({"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if ends else {})}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


class _Rolling(StatefulProcessor):
    """Of each video: the last surviving text, what number comes next in and out, cues that wait for one before them, and when it was last seen."""

    def __init__(self, wait_s: float, idle_s: float) -> None:
        self.wait_ms, self.idle_ms = int(1000 * wait_s), int(1000 * idle_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "before string, next int, n int, seen long")
        self.waiting = handle.getMapState("waiting", "idx int", "start_s double, end_s double, text string")

    def _told(self, key: tuple, rows: list[tuple], before: str | None, n: int) -> tuple[list[tuple], str | None, int]:
        out = []
        for start, end, text in rows:
            if text and (left := new_words(before, text)):
                out.append((key[0], n, start, start + max(0.0, end - start), left))
                before, n = left, n + 1
        return out, before, n

    def _release(self, key: tuple, now: int, all_of_it: bool) -> pd.DataFrame:
        """Cues that follow on what has been told, or all that wait, in order of idx."""
        before, due, n, _ = self.last.get() if self.last.exists() else (None, 0, 0, now)
        ready = []
        if all_of_it:
            held = sorted((k[0], tuple(v)) for k, v in self.waiting.iterator())
            ready, due = [v for _, v in held], max([due, *(k + 1 for k, _ in held)])
            self.waiting.clear()
        else:
            while self.waiting.containsKey((due,)):
                ready.append(tuple(self.waiting.getValue((due,))))
                self.waiting.removeKey((due,))
                due += 1
        rows, before, n = self._told(key, ready, before, n)
        self.last.update((before, due, n, now))
        return pd.DataFrame(rows, columns=["video_id", "idx", "start_s", "end_s", "text"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        due = self.last.get()[1] if self.last.exists() else 0
        for part in rows:
            for row in part.itertuples():
                if row.idx >= due:  # one that was told already, or given up, is not told again
                    self.waiting.updateValue((int(row.idx),), (float(row.start_s), float(row.end_s), row.text))
        yield self._release(key, now, False)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(now + (self.wait_ms if any(True for _ in self.waiting.keys()) else self.idle_ms))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if any(True for _ in self.waiting.keys()):
            yield self._release(key, now, True)
            self.handle.registerTimer(now + self.idle_ms)
        else:
            self.last.clear()

    def close(self) -> None:
        pass


def drop_rolling_stream(cues: DataFrame, wait_s: float = WAIT_S, idle_s: float = IDLE_S) -> DataFrame:
    """drop_rolling for a stream, in whatever order cues arrive: the same cues as of all at once.

    Cues are numbered from 0 without gaps, as normalise_rows has them. One that comes before its turn waits in the
    state, for wait_s at most: then what waits is taken in its order and what was missing is given up. A video is
    forgotten idle_s after its last cue. Output is appended. Needs the RocksDB state store (see rocksdb).
    """
    spark = cues.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    ship(spark)
    # Cues that cleaning empties stay, as their numbers are waited for.
    cleaned = cues.select("video_id", "idx", "start_s", "end_s", F.coalesce(clean_text(F.col("text")), F.lit("")).alias("text"))
    return cleaned.groupBy("video_id").transformWithStateInPandas(_Rolling(wait_s, idle_s), CUES, "Append", "ProcessingTime")


def append_messages(messages: DataFrame, path: str, checkpoint: str):
    """An append-only message log: a streaming write that adds each message once."""
    return messages.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def run_queue(jobs: DataFrame, done: Callable[[], DataFrame], work: Callable[[DataFrame], None], checkpoint: str):
    """A resumable queue over a stream of jobs(job_id, ...): each micro-batch works on the jobs that done() lacks.

    The checkpoint replays a batch that broke off, and the anti-join keeps what it had finished from running again.
    """

    def batch(part: DataFrame, _: int) -> None:
        work(part.dropDuplicates(["job_id"]).join(done().select("job_id"), "job_id", "left_anti"))

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def activity(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n) of events(ts, event_type): counts in tumbling windows; a window closes `late` after its end."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """(key, session_start, session_end, n, value) of events(key, ts, value): runs of events of which each comes within `gap` of the one before.

    An event that lies between two sessions makes them one, in whatever order they came. In a stream a session is
    told once `late` has passed since its end; events that come later than that are left out and counted (see
    LateRows). Sessions without a key are sessions of the null key; events without a time are in none.
    """
    line = events.filter(F.col("ts").isNotNull()).withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("s"))
    return line.agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.max("ts").alias("last")).select(key, F.col("s.start").alias("session_start"), F.col("last").alias("session_end"), "n", "value")


class LateRows(StreamingQueryListener):
    """Counts what streams left out as too late; events of one key and the very same time count once. Add it with spark.streams.addListener."""

    def __init__(self) -> None:
        self.n = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.n += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        pass
