"""Quality by compression: zstandard dictionaries of good and of bad text, and which of the two compresses better."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns
from .langid import _draw

#: Labelled rows of each class that the fit takes, about, and the characters of each: of a longer text so many in blocks from all over it.
ROWS_PER_CLASS, CHARS_PER_ROW = 1200, 32_768
DICTIONARY_BYTES = 64 << 10
#: Each block of a text is compressed by itself, else a long text teaches the compressor more than the dictionary does.
BLOCK = 4096
LEVEL = 3


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where training finds too little in common, pieces from all over the texts themselves."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        trained = b""
    if len(trained) >= min(DICTIONARY_BYTES, sum(map(len, blocks))) // 4:
        return trained
    share = max(1, DICTIONARY_BYTES // max(1, len(blocks)))
    return b" ".join(b[:share] for b in blocks)[-DICTIONARY_BYTES:] or b" "


class Sizer:
    """Compressed sizes of whole texts under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        make = lambda raw: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=False, write_content_size=False, write_dict_id=False)
        self.good, self.bad = make(good), make(bad)

    def difference(self, text: bytes) -> float:
        """(bad - good) / (bad + good) compressed bytes; positive where the good dictionary fits better, 0 if empty."""
        good = bad = 0
        for i in range(0, len(text), BLOCK):
            part = text[i : i + BLOCK]
            good += len(self.good.compress(part))
            bad += len(self.bad.compress(part))
        return (bad - good) / (bad + good) if good + bad else 0.0


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit of y on x, by Newton steps with a slight pull to zero."""
    a = b = 0.0
    weight = weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 1e-6 * a, (weight * (p - y)).sum() + 1e-6 * b])
        v = weight * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-6, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Model:
    good: bytes
    bad: bytes
    scale: float
    slope: float
    offset: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x / self.scale + self.offset, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int = ROWS_PER_CLASS, chars_per_row: int = CHARS_PER_ROW) -> Model:
    """Fit on about rows_per_class labelled rows of each class (label 1, and all others).

    A text of over chars_per_row characters teaches by blocks of BLOCK characters at even distances, so many in all.
    Half of each class makes its dictionary, the other half the calibration, weighted to the classes' true
    shares. Without rows of a class the score of every text is that of the offset.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, (F.col(label_col) == 1).cast("int").alias("y")).distinct()
    drawn, counts = _draw(known, [id_col], "y", rows_per_class)
    blocks = max(1, chars_per_row // BLOCK)
    apart = F.char_length(text_col) / blocks
    short = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.substring(F.col(text_col), (i * apart).cast("int") + 1, F.lit(BLOCK))), "")
    part = F.when(F.char_length(text_col) <= chars_per_row, F.col(text_col)).otherwise(short)
    bounded = F.broadcast(drawn)  # at most 4 * rows_per_class rows of an id and a label
    rows = documents.filter(F.col(text_col).isNotNull()).select(id_col, text_col).join(bounded, id_col).limit(8 * rows_per_class).select("y", part.alias("text"), F.pmod(F.xxhash64(id_col, F.lit("half")), F.lit(2)).alias("half")).collect()
    rows.sort(key=lambda r: (r.y, r.text))
    text = lambda y, half: [r.text.encode() for r in rows if r.y == y and r.half == half]
    good, bad = _dictionary(text(1, 0)), _dictionary(text(0, 0))
    sizer = Sizer(good, bad)
    held = [(sizer.difference(t), y) for y in (0, 1) for t in text(y, 1)]
    total = sum(counts.values())
    prior = (counts.get(1, 0) + 0.5) / (total + 1)
    if len({y for _, y in held}) < 2:
        return Model(good, bad, 1.0, 0.0, float(np.log(prior / (1 - prior))))
    x, y = np.array([d for d, _ in held]), np.array([y for _, y in held], float)
    scale = float(x.std()) or 1.0
    weight = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum())
    return Model(good, bad, scale, *calibrate(x / scale, y, weight))


def score_quality(df: DataFrame, model: Model, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """df with the quality of each whole text from 0 to 1, higher where label 1 is likelier.

    Null and empty texts have difference 0 and get the score of that. A column named like out is replaced; all
    rows are kept.
    """

    def setup():
        sizer = Sizer(model.good, model.bad)
        return lambda texts: [pa.array(model.score(np.array([sizer.difference(t) for t in texts])), pa.float64())]

    return append_columns(df, text_col, [T.StructField(out, T.DoubleType())], setup)
