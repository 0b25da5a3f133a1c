"""Cues of a video, (video_id, idx, start_s, end_s, text): normalising, cleaning and rolling duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .scan import scan

CUES = "video_id string, idx int, start_s double, end_s double, text string"


def normalise_rows(rows: DataFrame) -> DataFrame:
    """Cues of raw rows (video_id, idx, start_s, duration_s, text): trimmed, empty ones dropped, counted anew from 0.

    A missing start or duration is 0.
    """
    start = F.coalesce("start_s", F.lit(0.0))
    kept = rows.select("video_id", "idx", start.alias("start_s"), (start + F.coalesce("duration_s", F.lit(0.0))).alias("end_s"), tx.squeeze(F.col("text")).alias("text")).filter("text <> ''")
    return kept.withColumn("idx", F.row_number().over(Window.partitionBy("video_id").orderBy("idx")) - 1)


def clean(cues: DataFrame, composed: bool = True) -> DataFrame:
    """Cues with cleaned text; those left empty go, indexes stay."""
    return cues.withColumn("text", tx.clean_text(F.col("text"), composed)).filter("text <> ''")


def new_words(before: str | None, text: str, limit: int = tx.OVERLAP_WORDS) -> str:
    """text without its longest first words (at most limit) that before ends with, whatever their case.

    The words of both are joined with a mark between them; an overlap is a border of that sequence, and borders are
    found by the failure links of the sequence, each in one step from the one before.
    """
    words = text.split()
    line = [w.lower() for w in words[:limit]] + [None] + [w.lower() for w in (before or "").split()[-limit:]]
    links = [0] * len(line)
    for i in range(1, len(line)):
        k = links[i - 1]
        while k and line[i] != line[k]:
            k = links[k - 1]
        links[i] = k + (line[i] == line[k])
    return " ".join(words[links[-1] :]) if links[-1] else text


class _Rolling:
    """Holds the last text that survived, as it survived."""

    def __init__(self) -> None:
        self.before: str | None = None
        self.n = 0

    def feed(self, row: dict) -> list[tuple]:
        text = new_words(self.before, row["text"])
        if not text:
            return []
        self.before, self.n = text, self.n + 1
        start = row["start_s"]
        return [(row["video_id"], self.n - 1, start, start + max(0.0, row["end_s"] - start), text)]

    def close(self) -> list[tuple]:
        return []


def drop_rolling(cues: DataFrame) -> DataFrame:
    """Cues without words that repeat the end of the surviving cue before; emptied cues go, the rest is counted from 0.

    Each cue is held against what the one before has become, which makes this a scan and not a window.
    """
    return scan(cues.select("video_id", "idx", "start_s", "end_s", "text"), ["video_id"], ["idx"], _Rolling, CUES)


def clean_transcript(cues: DataFrame, rolling: bool = True, composed: bool = True) -> DataFrame:
    cleaned = clean(cues, composed)
    if rolling:
        return drop_rolling(cleaned)
    return cleaned.withColumn("idx", F.row_number().over(Window.partitionBy("video_id").orderBy("idx")) - 1).withColumn("end_s", F.greatest("start_s", "end_s"))
