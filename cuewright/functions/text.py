"""Caption text: normalisation, annotations, speaker marks and overlaps with the text before."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What captions put in brackets, and the pattern of a speaker's mark.
ANNOTATIONS = ("music", "applause", "laughter", "inaudible", "silence", "foreign", "blank_audio", "crosstalk")
SPEAKER = r"^\s*(?:>>+|-\s|[A-Z][A-Z .'-]{1,24}:)\s*"
TAG = "</?[^>]{1,20}>"
#: Speaker marks that may stand one after the other.
SPEAKER_DEPTH = 3
#: Words that an overlap may have.
OVERLAP_WORDS = 12


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for; Arrow batches, one C call a text."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else None)


# A filter on what comes out would have the optimizer run it twice, in two Python workers a task, but for this.
nfkc = nfkc.asNondeterministic()


def compose(text: Column) -> Column:
    """NFKC, where Python sees only texts with a character that it could change, and nulls for the others."""
    able = text.rlike("[^\\x00-\\x7F]")
    return F.when(able, nfkc(F.when(able, text))).otherwise(text)


def strip_annotations(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)[\[\(](?:" + "|".join(ANNOTATIONS) + r")[^\])]*[\]\)]", " ")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, " ")


def strip_speakers(text: Column) -> Column:
    """Without leading speaker marks, up to SPEAKER_DEPTH of them; once none is left a further pass changes nothing."""
    for _ in range(SPEAKER_DEPTH):
        text = F.regexp_replace(text, SPEAKER, "")
    return text


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_text(text: Column, composed: bool = True) -> Column:
    """The cleaned text of one cue. composed=False leaves out NFKC for texts known to be composed already. Null stays null."""
    text = compose(text) if composed else text
    text = F.translate(F.replace(text, F.lit("​"), F.lit("")), " ", " ")
    return squeeze(strip_speakers(strip_annotations(strip_tags(text))))


def without_overlap(before: Column, text: Column, limit: int = OVERLAP_WORDS) -> Column:
    """text without the longest run of first words (at most limit) that before ends with, whatever their case."""
    words = lambda t: F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    last, first = F.transform(words(before), F.lower), F.transform(words(text), F.lower)
    most = F.least(F.lit(limit), F.size(last), F.size(first))
    # sequence(1, 0) would count down, so the guard stands first.
    fits = F.filter(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), lambda n: F.slice(last, F.size(last) - n + 1, n) == F.slice(first, F.lit(1), n))
    n = F.array_max(fits)
    return F.when(n.isNull() | before.isNull(), text).otherwise(F.array_join(F.slice(words(text), n + 1, F.greatest(F.size(first) - n, F.lit(0))), " "))


def punctuation_density(text: Column) -> Column:
    """Sentence ends per character; 0 for an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit("[.!?]")) / F.nullif(F.char_length(text), F.lit(0)), F.lit(0.0))
