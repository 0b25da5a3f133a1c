"""Language identification: the language family first, then one-versus-one linear SVMs within the family.

Features are hashed three-byte sequences of the letters. Families are found from the languages' mean features
unless they are given. The model is fitted on a bounded sample of labelled rows and applied to all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_text, prepare, slices

UNKNOWN = "und"
DIM = 2048
#: Labelled rows of each language that the fit takes, about; drawn by a hash of the id, so the draw is repeatable.
ROWS_PER_LANGUAGE = 600
#: Documents whose features are held as a dense block at a time.
BLOCK = 256

_letters = np.full(256, 32, np.uint8)
_letters[97:123] = np.arange(97, 123)
_letters[65:91] = np.arange(97, 123)
_letters[128:] = np.arange(128, 256)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of unit length for each text: square roots of the shares of its three-byte sequences by bucket."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, text in enumerate(texts):
        b = _letters[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
        code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        code = code[(b[1:-1] != 32) | (b[:-2] != 32)]
        counts = np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(21), minlength=DIM)
        out[i] = np.sqrt(counts / max(1, counts.sum()))
    return out


_ascii_letter = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ascii_letter.search(text)) or any(c.isalpha() for c in as_text(text))


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Weights and offset of a linear SVM with squared hinge loss, by accelerated gradient steps; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # All of one width, else each round would convert the whole matrix.
    y, weight = y.astype(np.float32), (weight / weight.sum()).astype(np.float32)
    w = before = np.zeros(x.shape[1], np.float32)
    step = 1 / (ridge + 4)
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - before)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        before, w = w, ahead - step * (ridge * ahead - 2 * x.T @ (weight * slack * y)).astype(np.float32)
    return w


def find_families(centres: dict[str, np.ndarray], count: int | None = None) -> dict[str, int]:
    """Group languages by mean linkage of their centres into `count` families (the square root of their number)."""
    groups = [[lang] for lang in sorted(centres)]
    count = count or max(1, round(len(groups) ** 0.5))
    while len(groups) > count:
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: np.mean([centres[m] @ centres[n] for m in groups[p[0]] for n in groups[p[1]]]))
        groups[a] += groups.pop(b)
    return {lang: i for i, g in enumerate(groups) for lang in g}


@dataclass
class Model:
    """Columns of `weights` are family SVMs (one against the rest), then pairs of languages of one family."""

    languages: list[str]
    family: dict[str, int]
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        known = np.array([has_letter(t) for t in texts], bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        families = max(self.family.values()) + 1
        langs, scores = [], np.zeros(len(texts))
        for at in range(0, len(texts), BLOCK):
            x = features(texts[at : at + BLOCK])
            if self.weights is None:
                langs += self.languages[:1] * len(x)
                scores[at : at + BLOCK] = 1.0
                continue
            margin = x @ self.weights[:-1] + self.weights[-1]
            of = margin[:, :families].argmax(axis=1) if families > 1 else np.zeros(len(x), np.int64)
            sure = 1 / (1 + np.exp(-3 * margin[np.arange(len(x)), of])) if families > 1 else np.ones(len(x))
            for i in range(len(x)):
                own = [lang for lang in self.languages if self.family[lang] == of[i]]
                votes = {lang: [0, 0.0] for lang in own}
                for k, (a, b) in enumerate(self.pairs):
                    if self.family[a] == of[i]:
                        m = float(margin[i, families + k])
                        votes[a if m > 0 else b][0] += 1
                        votes[a][1] += m
                        votes[b][1] -= m
                best = max(own, key=lambda lang: votes[lang])
                langs.append(best)
                close = min((m if a == best else -m for k, (a, b) in enumerate(self.pairs) if best in (a, b) for m in [float(margin[i, families + k])]), default=9.0)
                scores[at + i] = sure[i] / (1 + np.exp(-3 * close))
        scores[~known] = 0.0
        return [lang if k else UNKNOWN for lang, k in zip(langs, known)], scores


def _draw(labelled: DataFrame, by: list[str], label_col: str, rows: int) -> tuple[DataFrame, dict]:
    """About `rows` rows of each label, at most twice as many of all, by a hash of the columns `by`; and the number of rows of each label."""
    counts = {r[0]: r[1] for r in labelled.groupBy(label_col).count().collect()}
    share: Column = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col(label_col) == F.lit(label), F.lit(min(1.0, rows / n))).otherwise(share)
    drawn = labelled.filter(F.pmod(F.xxhash64(*by, F.lit("draw")), F.lit(1 << 20)) < share * (1 << 20))
    return drawn.limit(2 * rows * max(1, len(counts))), counts


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, families: dict[str, int] | None = None) -> Model:
    """Fit on the rows with a language and a letter; only their features, rows_per_language of each, reach the driver."""
    prepare(labelled)
    drawn, _ = _draw(labelled.filter(F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col), [id_col, text_col], lang_col, rows_per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 0):
                x = (features(texts) * 4096).astype(np.uint16)
                keep = [has_letter(t) for t in texts]
                rows = [r.tobytes() if k else None for r, k in zip(x, keep)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(rows, pa.binary())], names=["lang", "x"])

    got = [r for r in drawn.select(text_col, lang_col).mapInArrow(run, "lang string, x binary").collect() if r.x is not None]
    got.sort(key=lambda r: (r.lang, bytes(r.x)))
    languages = sorted({r.lang for r in got})
    x = np.array([np.frombuffer(r.x, np.uint16) for r in got], np.float32) / 4096 if got else np.zeros((0, DIM), np.float32)
    y = np.array([r.lang for r in got])
    family = families or find_families({lang: x[y == lang].mean(axis=0) for lang in languages})
    ids = {f: i for i, f in enumerate(sorted({family[lang] for lang in languages}))}
    model = Model(languages, {lang: ids[family[lang]] for lang in languages})
    if len(languages) < 2:
        return model
    of = np.array([model.family[lang] for lang in y])
    even = {lang: 1 / (y == lang).sum() for lang in languages}
    weight = np.array([even[lang] for lang in y])
    columns = [fit_svm(x, np.where(of == f, 1, -1), weight) for f in range(len(ids))]
    model.pairs = [(a, b) for a, b in combinations(languages, 2) if model.family[a] == model.family[b]]
    for a, b in model.pairs:
        here = (y == a) | (y == b)
        columns.append(fit_svm(x[here], np.where(y[here] == a, 1, -1), weight[here]))
    model.weights = np.array(columns, np.float32).T
    return model


def identify(df: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """df with the language of each whole text and a score from 0 to 1.

    Null texts and texts without a letter get `und` and 0; so do all texts if no language was learned. With one
    learned language every other text gets it. Columns named like the new ones are replaced; all rows are kept.
    """

    def setup():
        def compute(texts: list[bytes]) -> list[pa.Array]:
            langs, scores = model.predict(texts)
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return compute

    return append_columns(df, text_col, [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())], setup)
